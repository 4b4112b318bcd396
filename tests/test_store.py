"""The versioned store by its commands."""

import json

from chronolith import cli
from chronolith.store import Store


def test_commands(spark, tmp_path):
    at = str(tmp_path / "store")
    call = lambda *argv: cli.run(spark, ["--store", at, *argv])
    video = tmp_path / "demo_v1.mp4"
    video.write_bytes(b"first")
    assert json.loads(call("check-video", "--video", str(video), "--seconds", "100")[1][0])["status"] == "NEW_VIDEO"
    entry = json.loads(call("register-video", "--video", str(video), "--seconds", "100", "--functionalities", "F-1, F-2")[1][0])
    assert entry["title"] == "demo_v1" and entry["status"] == "PROCESSED" and entry["functionalities"] == ["F-1", "F-2"]
    call("register-video", "--video", str(video))
    assert len(call("list-videos")[1]) == 1 and json.loads(call("check-video", "--video", str(video))[1][0])["status"] == "EXACT_DUPLICATE"
    other = tmp_path / "demo_v2.mp4"
    other.write_bytes(b"second")
    got = json.loads(call("check-video", "--video", str(other), "--seconds", "150")[1][0])
    assert (got["status"], got["suggested_version"], got["match"]) == ("NEW_VERSION", 2, entry["video_id"])

    case = ["--name", "Alta de cliente", "--objective", "registrar al cliente"]
    moment = ["--video", entry["video_id"], "--ts-start", "00:00:10", "--ts-end", "00:00:20"]
    assert json.loads(call("match-use-case", *case)[1][0])["status"] == "NEW"
    call("add-use-case", *case, *moment, "--business-rule", "R2")
    assert json.loads(call("add-use-case", *case, *moment)[1][0])["status"] == "DUPLICATE"
    (uc,) = map(json.loads, call("list-use-cases")[1])
    assert uc["use_case_id"] == "UC-001" and len(uc["evidence"]) == 2 and uc["confidence"] == "MEDIUM"
    call("add-use-case", *case, *moment, "--force-new")
    assert len(call("list-use-cases")[1]) == 2
    assert call("add-evidence", "--use-case", "UC-009", *moment)[0] == 1
    assert len(json.loads(call("add-evidence", "--use-case", "UC-001", *moment)[1][0])["evidence"]) == 3
    new = json.loads(call("update-use-case", "--use-case", "UC-001", "--reason", "r", "--business-rule", "R1", "--flow", "f")[1][0])
    assert (new["version"], new["business_rules"], new["flow"], new["name"]) == (2, ["R1", "R2"], "f", "Alta de cliente")
    assert call("update-use-case", "--use-case", "UC-009", "--reason", "r")[0] == 1
    events = [json.loads(x) for x in call("history", "--entity", "UC-001")[1]]
    assert sorted(e["action"] for e in events) == ["CREATED", "EVIDENCE_ADDED", "EVIDENCE_ADDED", "UPDATED"]
    assert json.loads(next(e["previous"] for e in events if e["action"] == "UPDATED"))["version"] == 1
    assert Store(spark, at).table("use_cases", version=1).count() == 1


def test_import_and_gate(spark, tmp_path):
    memory = tmp_path / "m.json"
    memory.write_text(json.dumps({"videos": [{"video_id": "a", "file_name": "x.mp4"}], "analysis_history": [{"action": "CREATED", "entity": "a"}]}))
    at = ["--store", str(tmp_path / "s")]
    assert cli.run(spark, [*at, "import", "--memory", str(memory)])[0] == 0
    assert len(cli.run(spark, [*at, "list-videos"])[1]) == 1 and len(cli.run(spark, [*at, "history"])[1]) == 1
    checks = tmp_path / "c.json"
    checks.write_text(json.dumps({"name": "x", "exists": False}))
    code, lines = cli.run(spark, [*at, "verify", "--checks", str(checks)])
    assert code == 2 and json.loads(lines[-1])["verdict"] == "FAIL"
