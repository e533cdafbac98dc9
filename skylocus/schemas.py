"""Schemas of the domain tables."""

from __future__ import annotations

LOCATION = "struct<source:string,latitude:double,longitude:double,altitude:double,accuracy:double,time:bigint,provider:string,speed:double,bearing:double>"
_INFO = "struct<bssid:string,ssid:string,numOfScanResults:int,linkSpeed:int,frequency:int,rssi:int,capabilities:string,centerFreq0:int,centerFreq1:int,channelWidth:int,operatorFriendlyName:string,venueName:string,is80211mcResponder:boolean,isPasspointNetwork:boolean>"

#: A device's scan document; disconnected events are not read (T-25).
RAW_SCAN = (
    "osVersion string, model string, device string, manufacturer string, osName string, sdkInt string, appNameVersion string, dataVersion string, "
    f"wifiConnectedEvents array<struct<timestamp:bigint,eventId:string,eventType:string,did:string,isCaptive:boolean,returnedIP:string,wifiConnectedInfo:{_INFO},location:{LOCATION}>>, "
    f"scanResults array<struct<timestamp:bigint,mode:string,location:{LOCATION},results:array<struct<ssid:string,bssid:string,scantime:bigint,rssi:int,level:int>>>>, _corrupt string"
)

#: The measurement table, 45 columns in order.
MEASUREMENT = (
    "bssid string, id string, measurement_timestamp bigint, event_id string, device_id string, device_model string, device_manufacturer string, os_version string, app_version string, "
    "latitude double, longitude double, altitude double, location_accuracy double, location_timestamp bigint, location_provider string, location_source string, speed double, bearing double, "
    "ssid string, rssi int, frequency int, scan_timestamp bigint, connection_status string, quality_weight double, link_speed int, channel_width int, center_freq0 int, center_freq1 int, "
    "capabilities string, is_80211mc_responder boolean, is_passpoint_network boolean, operator_friendly_name string, venue_name string, is_captive boolean, num_scan_results int, "
    "is_global_outlier boolean, global_outlier_distance double, global_outlier_threshold double, global_detection_algorithm string, global_detection_timestamp timestamp, "
    "global_detection_version string, ingestion_timestamp timestamp, data_version string, processing_batch_id string, quality_score double"
)

REGISTRY = (
    "mac_addr string, version string, latitude double, longitude double, altitude double, horizontal_accuracy double, vertical_accuracy double, confidence double, "
    "ssid string, frequency int, vendor string, status string, geohash string"
)

REQUEST = "request_id string, client string, application string, calculation_detail boolean, scans array<struct<mac_addr:string,signal_strength:double,frequency:int,ssid:string,link_speed:int,channel_width:int>>"

#: Object-created notification; event-bus messages carry the same under ``detail``.
FILE_EVENT = (
    "Records array<struct<eventVersion:string,eventSource:string,awsRegion:string,eventTime:string,responseElements:struct<`x-amz-request-id`:string>,"
    "s3:struct<bucket:struct<name:string>,object:struct<key:string,size:bigint,eTag:string,sequencer:string>>>>, "
    "source string, region string, time string, detail struct<bucket:struct<name:string>,object:struct<key:string,size:bigint,etag:string,sequencer:string>>"
)

#: Provider A's answer and request in a comparison report.
REPORT = (
    "sourceRequest struct<svcBody:struct<svcReq:struct<clientId:string,requestId:string,wifiInfo:array<struct<id:string,signalStrength:double,frequency:int,ssid:string>>,cellInfo:array<map<string,string>>>>>, "
    "sourceResponse struct<success:boolean,locationInfo:struct<latitude:double,longitude:double,accuracy:double,altitude:double,confidence:double>,requestId:string,transactionId:string,errorMessage:string,errorCode:string,"
    "svcError:struct<errors:array<struct<code:string,message:string,description:string>>>>, "
    "options struct<calculationDetail:boolean,processingMode:string>"
)
