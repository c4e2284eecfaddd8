"""A small project from end to end."""

import pytest

from pyspark.sql import functions as F

from siftline.plans.scan import Scan
from siftline.sources.baseline import ScanSettings

PROJECT = {
    "command_injection.py": 'import subprocess\nfrom flask import request\ndef run_command(target):\n    return subprocess.run("ping " + target, shell=True)\n\ndef ping():\n    host = request.args.get("host")\n    return run_command(host)\n',
    "docker-compose.yml": "services:\n  db:\n    image: postgres\n    ports:\n      - \"5432:5432\"\n    environment:\n      POSTGRES_PASSWORD: postgres\n  web:\n    image: app\n",
    "hardcoded_auth.py": 'ADMIN_TOKEN = "Bearer ' + "abcdef1234567890" + '"\npassword = "' + "supersecret" + '"\n',
    "predictable_token.py": "import base64\ndef make(user):\n    token = base64.b64encode(user.email)\n    return token\n",
    "sql_injection.py": 'def find(cursor, user_id):\n    q = f"SELECT * FROM notes WHERE user_id = {user_id}"\n    cursor.execute(q)\n',
    "weak_password_hash.py": "import hashlib\ndef h(password):\n    return hashlib.md5(password)\n",
    "webhook.py": '@app.route("/webhook")\ndef stripe_webhook():\n    data = request.get_json()\n    return data\n',
    ".env": "DEBUG=true\nAWS_KEY=AKIA" + "Q7ZD2MWXK4PLT8RB" + "\n",
    "Dockerfile": "FROM node\nENV SECRET_KEY=abc\nCOPY . .\n",
    "tests/test_x.py": 'password = "' + "inatestfile" + '"\n',
    "vendor/y.py": 'password = "' + "invendored" + '"\n',
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("p", k, k.rpartition("/")[2], v) for k, v in PROJECT.items()], "project string, rel_path string, name string, content string")


def test_project(spark, files):
    r = Scan(files).run()
    found = r.findings.collect()
    detectors = {d for x in found for d in x.detector_ids}
    assert {"VG-SAST-001", "VG-SAST-002", "VG-AUTH-001", "VG-AUTH-002", "VG-AUTH-003", "VG-WEBHOOK-001", "VG-SEC-001", "VG-SEC-006", "VG-CFG-001", "VG-DCK-001", "VG-DCK-006", "VG-DCK-014", "VG-TAINT-CMD", "VG-SECRET-FILE"} <= detectors
    assert not [x for x in found if x.file.startswith(("tests/", "vendor/"))]
    assert len({(x.file, x.line, x.canonical_rule) for x in found if x.line}) == len([x for x in found if x.line])
    flow = [x for x in found if "VG-TAINT-CMD" in x.detector_ids and x.data_flow]
    assert flow and "request.args" in flow[0].source
    s = r.scores.first()
    assert s.gate == "BLOCKED" and s.critical > 0 and r.chains.count() > 0 and r.scope.first().config_aware > 0
    again = Scan(files).run().findings
    assert {x.finding_key for x in again.collect()} == {x.finding_key for x in found}


def test_switches_and_suppressions(spark, files):
    off = ScanSettings(secret_scan=False, source_scan=False)
    assert Scan(files, off).run().findings.count() == 0
    assert Scan(files.limit(0)).run().findings.count() == 0
    only = Scan(files, ScanSettings(source_scan=False)).run().findings
    assert {x.category for x in only.collect()} == {"secret"}
    s = spark.createDataFrame([("p", None, ".env", None, None)], "project string, rule_id string, file string, line int, expires string")
    left = Scan(files, ScanSettings(source_scan=False), suppressions=s).run().findings
    assert ".env" not in {x.file for x in left.collect()} and left.count() > 0


def test_dependencies_belong_to_their_projects(spark, files):
    deps = [("p", "npm", "Lib", "1.0.0", "web/package.json"), ("q", "npm", "lib", "1.0.0", "package.json"), ("q", "npm", "lib", "1.0.0", "api/package.json"), ("r", "npm", "lib", "2.0.0", "package.json")]
    d = spark.createDataFrame(deps, "project string, ecosystem string, name string, version string, source_file string")
    a = spark.createDataFrame([(1, "CVE-1", "npm", "lib", "CRITICAL", None, ["1.0.0"], [], "s", "d", [])], "adv_key long, id string, ecosystem string, package string, severity string, ranges array<struct<range_type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>, affected_versions array<string>, fixed_versions array<string>, summary string, description string, aliases array<string>")
    s = spark.createDataFrame([("q", "Vulnerable dependency lib 1.0.0", "api/package.json", None, None)], "project string, rule_id string, file string, line int, expires string")
    r = Scan(files.limit(0), deps=d, advisories=a, suppressions=s).run()
    assert {(x.project, x.file) for x in r.findings.collect()} == {("p", "web/package.json"), ("q", "package.json")}
    assert {x.project: x.gate for x in r.scores.where(F.col("critical") > 0).collect()} == {"p": "BLOCKED", "q": "BLOCKED"}
