"""The front door: texts, files, settings and the command line."""

import json

from indicant.__main__ import main
from indicant.api import extract_text
from indicant.config import persistence
from indicant.operators.store import Store
from indicant.operators.warninglists import SCHEMA


def test_extract_text(spark):
    lists = spark.createDataFrame([("d", "Known", "seen", "string", ["domain"], ["known.org"])], SCHEMA)
    normal, warned = extract_text(spark, "evil.net known.org a@known.org 1.2.3.4", lists, ["domains", "emails", "ips"])
    assert normal == {"domains": ["evil[.]net"], "ips": ["1[.]2[.]3[.]4"]}
    assert warned == {"domains": [{"value": "known[.]org", "warning_list": "Known", "description": "seen"}]}
    assert extract_text(spark, "nothing", None, ["cves"]) == ({}, {})


def test_precedence_of_settings(tmp_path):
    ini = tmp_path / "c.ini"
    ini.write_text("[database]\npersist = yes\npath = /from/ini\n")
    assert persistence(ini=str(ini), env={}) == persistence(True, "/from/ini", env={})
    assert persistence(ini=str(ini), env={"INDICANT_PERSIST": "off", "INDICANT_STORE": "/env"}).enabled is False
    assert persistence(True, "/arg", str(ini), {"INDICANT_PERSIST": "0", "INDICANT_STORE": "/env"}).path == "/arg"
    assert not persistence(env={}).enabled


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "report.txt").write_text("CVE-2024-12345 at evil.net")
    args = [str(tmp_path / "in"), "--format", "json", "--output", str(tmp_path / "out"), "--persist", "--store", str(tmp_path / "db")]
    assert main(args) == 0 and "cves: 1" in capsys.readouterr().out
    out = (tmp_path / "out" / "report_iocs.json").read_text()
    assert json.loads(out)["cves"] == ["CVE-2024-12345"]
    assert main([*args[:1], "--format", "text"]) == 0 and "## Domains" in capsys.readouterr().out
    db = Store(spark, str(tmp_path / "db"))
    assert db.runs().count() == 1 and db.iocs().count() == 3


def test_command_line_types_and_bad_files(spark, tmp_path, capsys):
    from indicant.__main__ import main

    (tmp_path / "a.txt").write_text("see 9.8.7.6 and u@v.org")
    (tmp_path / "b.pdf").write_bytes(b"no parser for this")
    assert main([str(tmp_path), "--types", "ips, cves", "--lax"]) == 0
    printed = capsys.readouterr().out
    assert "9[.]8[.]7[.]6" in printed and "u[@]v" not in printed and "ips: 1" in printed
