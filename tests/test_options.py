"""Options files."""

import pytest

from treelens.sources import options


def test_options():
    text = "# mine\ncve = CVE-2020-0001 2020-0002\nverbose = 2\nexploit = Yes\ncheck_strict = f\nkernel = /src/a b\nfiles =\n"
    assert options.parse(text) == {"cve": ["CVE-2020-0001", "2020-0002"], "verbose": 2, "exploit": True, "check_strict": False, "kernel": "/src/a b", "files": []}
    assert options.parse("") == {}
    for wrong in ("verbose = loud", "exploit = maybe"):
        with pytest.raises(ValueError, match=wrong.split()[0]):
            options.parse(wrong)


def test_conflicts():
    options.check({"all_files": True, "files": []})
    options.check({"files": ["drivers/"], "ignore_files": ["net/"]})
    for name in ("files", "ignore_files"):
        with pytest.raises(ValueError, match=name):
            options.check({"all_files": True, name: ["net/"]})
