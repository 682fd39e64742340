"""The command line and the programs' interface, on a small tree."""

import json

import pytest

from treelens import api, command
from treelens.functions import makefile

GREP = "/// Files: net/a.c net/gone.c\n/// Fix: f1\n/// Fixes: f0\n\n// a comment\nunsafe_copy\nlen > MAX\n"
STRUCTURAL = "/// Files: drivers/b.c drivers/b.h\n/// Version: 1.0.8\n\nvirtual detect\n\n@err exists@\nposition p;\n@@\nprobe(...)\n{\n\t...\n\tenable@p(dev);\n\t... when != check(dev)\n\tuse(dev);\n\t...\n}\n\n@script:python depends on detect@\np << err.p;\n@@\n\ncoccilib.report.print_report(p[0], 'ERROR: x')\n"
TREE = {
    "Makefile": "VERSION = 5\nPATCHLEVEL = 4\nSUBLEVEL = 1\nEXTRAVERSION = -rc2\nNAME = Test\n", "Kbuild": "obj-$(CONFIG_NET) += net/\nobj-y += drivers/\n", "net/Makefile": "obj-$(CONFIG_A) += a.o\n", "drivers/Makefile": "obj-$(CONFIG_B) += b.o\n",
    "net/a.c": "void f(void)\n{\n\tunsafe_copy(x);\n\tif (len > MAX)\n\t\treturn;\n}\n", "drivers/b.c": "int probe(struct device *dev)\n{\n\tenable(dev);\n\tuse(dev);\n\treturn 0;\n}\n", "arch/x86/x.c": "", ".config": "#\n# Linux/x86 5.4.1 Kernel Configuration\n#\nCONFIG_NET=y\nCONFIG_A=m\n# CONFIG_B is not set\n",
}


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    root = tmp_path_factory.mktemp("audit")
    for path, text in TREE.items():
        (root / "tree" / path).parent.mkdir(parents=True, exist_ok=True)
        (root / "tree" / path).write_text(text)
    rules = {"CVE-2020-0001.grep": GREP, "CVE-2020-0002.cocci": STRUCTURAL, "disputed/CVE-2020-0003.grep": GREP.replace("net/a.c", "drivers/b.c").replace("unsafe_copy", "enable").replace("len > MAX\n", ""), "CVE-2020-0004.cocci": STRUCTURAL.replace("...\n\tenable", "... when exists\n\tenable"), "CVE-2020-0005.cocci": STRUCTURAL.replace("1.0.8", "9.0.0"), "CVE-2020-0006.grep": GREP.replace("unsafe_copy", "(["), "CVE-2020-0007.grep": GREP.replace("net/a.c ", "")}
    (root / "rules/disputed").mkdir(parents=True)
    for name, text in rules.items():
        (root / "rules" / name).write_text(text)
    import gzip

    with gzip.open(root / "meta.json.gz", "wt") as file:
        json.dump({"CVE-2020-0001": {"cmt_msg": "net: copy", "fix_date": 1586000000, "exploit": True}}, file)
    return root


def run(spark, place, capsys, *args):
    code = command.main(["--rules", str(place / "rules"), "--kernel", str(place / "tree"), "--metadata", str(place / "meta.json.gz"), *args], spark)
    said = capsys.readouterr()
    return code, said.out, said.err


def test_scan_and_report(spark, place, capsys, monkeypatch):
    monkeypatch.setenv("HOME", str(place))
    code, out, err = run(spark, place, capsys, "--cve", "all", "--kernel-config", "--report", str(place / "r.json"))
    assert code == 0
    read = json.loads((place / "r.json").read_text())
    assert list(read) == ["args", "config", "kernel", "results", "tools"]
    assert read["args"]["cve"] == [f"CVE-2020-000{i}" for i in range(1, 8)] and read["args"]["arch"] == "x86" and read["kernel"]["full"] == "5.4.1-rc2"
    assert read["config"] == {"arch": "x86", "version": "5.4.1"} and read["tools"] == command.versions()
    assert sorted(read["results"]) == ["CVE-2020-0001", "CVE-2020-0002", "CVE-2020-0003"]
    one, two = read["results"]["CVE-2020-0001"], read["results"]["CVE-2020-0002"]
    assert one["cmt_msg"] == "net: copy" and one["files"] == [{"file": "net/a.c"}]
    assert one["config"] == {"affected": True, "files": {"net/a.c": {"logic": "CONFIG_A & CONFIG_NET", "mapped": True, "config": True}}}
    assert two["files"] == [{"file": "drivers/b.c", "line": 3}] and two["config"]["affected"] is False
    assert "Found: CVE-2020-0001\nMSG: net: copy\nFIX DATE: 2020-04-04\nhttps://www.cve.org/CVERecord?id=CVE-2020-0001\nAffected Files:\n - net/a.c: CONFIG_A & CONFIG_NET\n   " in out
    assert "skipping CVE-2020-0004: unsupported: when exists" in err and "skipping CVE-2020-0005: requires version 9.0.0" in err and "skipping CVE-2020-0006" in err
    code, out, _ = run(spark, place, capsys, "--cve", "all", "--kernel-config", str(place / "tree/.config"), "--check-strict")
    assert code == 0 and "CVE-2020-0001" in out and "CVE-2020-0002" not in out


def test_choice_of_rules(spark, place, capsys, monkeypatch):
    monkeypatch.setenv("HOME", str(place))
    found = lambda *args: sorted(x.removeprefix("Found: ") for x in run(spark, place, capsys, *args)[1].split("\n") if x.startswith("Found"))
    assert found() == ["CVE-2020-0001", "CVE-2020-0002"]
    assert found("--cve", "disputed") == ["CVE-2020-0003"]
    assert found("--cve", "2020-0002", "CVE-2020-0003", "--files", "drivers/") == ["CVE-2020-0002", "CVE-2020-0003"]
    assert found("--exploit") == ["CVE-2020-0001"]
    (place / "out").write_text("# not these\n2020-0001\n")
    assert found("--exclude", str(place / "out"), "2020-0009") == ["CVE-2020-0002"]
    assert found("--ignore-files", "net") == ["CVE-2020-0002"]
    assert found("--all-files", "--cve", "2020-0007") == ["CVE-2020-0007"]
    (place / ".config").mkdir(exist_ok=True)
    (place / ".config/treelens.ini").write_text("cve = CVE-2020-0001\n")
    assert found() == ["CVE-2020-0001"] and found("--cve", "all", "--exclude", "2020-0001") == ["CVE-2020-0002", "CVE-2020-0003"]
    (place / ".config/treelens.ini").unlink()
    assert command.main(["--rules", str(place / "rules"), "--list"], spark) == 0
    assert capsys.readouterr().out.split() == [f"CVE-2020-000{i}" for i in range(1, 8)]


@pytest.mark.parametrize(
    "args, said",
    [
        (["--cve", "nonsense"], "not a CVE id"), (["--cve", "2020-0042"], "unknown rules"), (["--exclude", "x"], "not a CVE id"), (["--all-files", "--files", "net/"], "all_files"), (["--files", "a b"], "not a path"),
        (["--kernel-config", "/nothing"], "no configuration"), (["--check-strict"], "needs --kernel-config"), (["--metadata", "/nothing.gz"], "no gzipped metadata"), (["--config", "/nothing.ini"], "no options file"),
        (["--arch", "arm", "--kernel-config"], "conflicts"), (["--arch", "vax"], "unknown architecture"), (["--kernel", "https://example.org/linux.git"], "isn't fetched"), (["--kernel", "/tmp/nothing"], "isn't a source tree"), (["--rules", "https://example.org/rules"], "isn't fetched"),
    ],
)
def test_refusals(spark, place, capsys, monkeypatch, args, said):
    monkeypatch.setenv("HOME", str(place))
    code, _, err = run(spark, place, capsys, *args)
    assert code == 1 and said in err


def test_architectures():
    there = {"arch/x86", "arch/arm"}.__contains__
    assert makefile.resolve_arch("x86_64", "i386", there) == ("x86_64", []) and makefile.resolve_arch(None, "arm", there) == ("arm", [])
    assert makefile.resolve_arch(None, None, there, config=".config") == ("x86", ["assuming architecture x86"])
    assert makefile.resolve_arch(None, None, {}.__contains__) == ("x86", ["there is no arch/x86"])
    for wrong in (("arm", "x86", there, False), ("mips", None, there, False), (None, None, there, True)):
        with pytest.raises(ValueError):
            makefile.resolve_arch(*wrong)


def test_interface(spark, place):
    audit = api.Audit(spark, str(place / "tree"), str(place / "rules"), str(place / "meta.json.gz"), "-")
    assert audit.ids("disputed") == {"CVE-2020-0003"} and len(audit.ids()) == 7
    assert audit.rule_files("CVE-2020-0001") == ["net/a.c", "net/gone.c"] and (audit.rule_fix("CVE-2020-0001"), audit.rule_fixes("CVE-2020-0001"), audit.rule_version("CVE-2020-0002")) == ("f1", "f0", "1.0.8")
    assert audit.exploit("CVE-2020-0001") is True and audit.exploit("CVE-2020-0002") is False and audit.metadata_of("CVE-2020-0009") == {}
    one = audit.check("CVE-2020-0001")
    assert one["matched"] == ["net/a.c"] and one["config"] == {"files": {"net/a.c": {"logic": "CONFIG_A & CONFIG_NET", "mapped": True}}}
    assert audit.check("CVE-2020-0007") is None and audit.check("CVE-2020-0004") is None
    with pytest.raises(KeyError):
        audit.check("CVE-2020-0009")
