import pathlib

import skylocus


def test_only_the_training_data_subpackage_names_itself():
    root = pathlib.Path(skylocus.__file__).parent
    files = [p for p in root.rglob("*.py") if p.relative_to(root).parts[0] != "llm"]
    assert files and not [str(p) for p in files if "skylocus.llm" in p.read_text(encoding="utf-8")]
