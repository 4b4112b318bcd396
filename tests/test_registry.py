"""The registry by its commands."""

import json

from chronolith import cli

CASES = """# Casos
## Caso 1: Jira y backlog
- **Tramo:** 00:00:10–00:05:00 · **menciones:** 6
## Caso 2: Pruebas QA
- **Tramo:** 00:01:00–00:40:00 · **menciones:** 5
"""


def test_registry_commands(spark, tmp_path):
    videos, made, discovery = (tmp_path / n for n in ("videos", "made", "discovery"))
    for folder in (videos, made, discovery / "Uno-Dos", discovery / "Otro"):
        folder.mkdir(parents=True)
    (videos / "Demo-Uno-Dos.mp4").write_bytes(b"one")
    (videos / "Sola.mp4").write_bytes(b"two")
    (discovery / "Uno-Dos" / "03_casos_de_uso.md").write_text(CASES)
    (made / "Capsula-Uno-Dos-CI-CD-01-02-2026.mp4").write_bytes(b"x")
    (made / "otra.mp4").write_bytes(b"x")
    folders = ["--videos", str(videos), "--made", str(made), "--discovery", str(discovery)]

    def call(*argv):
        code, lines = cli.run(spark, ["--store", str(tmp_path / "store"), *argv])
        return code, [json.loads(x) for x in lines]

    (only,) = call("list", "--made", str(made))[1]
    assert only["output"].startswith("Capsula-Uno")
    lines = call("more-cases", *folders)[1]
    focus = {x["topic"]: x["focus"] for x in lines if "candidate" not in x}
    new = [x["topic"] for x in lines if x.get("candidate")]
    assert focus == {"Jira / HDU": "new", "QA / Pruebas": "dispersed"} and new == ["Jira / HDU"]

    got = {x["video"]: x for x in call("record-videos", *folders, "--seconds", "Sola.mp4=60")[1]}
    demo, sola = got["Demo-Uno-Dos.mp4"], got["Sola.mp4"]
    assert demo["procesado"] and demo["capsulas"] == [only["output"]] and demo["discovery"] == "Uno-Dos" and demo["casos_nuevos"] == sorted(new)
    assert not sola["procesado"] and sola["duration_seconds"] == 60.0 and sola["registrado"]
    assert call("identify", "--video", str(videos / "Sola.mp4"))[1][0]["status"] == "EXACT_DUPLICATE"

    delete = lambda name, *more: (lambda r: (r[0], r[1][0]["decision"]))(call("delete-video", "--videos", str(videos), "--name", name, *more))
    assert delete("nada.mp4") == (1, "BLOCKED_NOT_REGISTERED") and delete("Sola.mp4", "--yes") == (1, "BLOCKED_NOT_PROCESSED")
    assert delete("Demo-Uno-Dos.mp4", "--yes") == (1, "BLOCKED_NEW_CASES")
    call("record", "--topic", "Jira y backlog", "--output", "x/Capsula-Jira.mp4", "--video", "Demo-Uno-Dos.mp4", "--dur", "61")
    call("record", "--topic", "t", "--output", "a.mp4")
    call("record", "--topic", "u", "--output", "a.mp4")
    assert [x["tema_canonico"] for x in call("list", "--made", str(made))[1] if x["output"] == "a.mp4"] == ["u"]
    call("record-videos", *folders)
    assert delete("Demo-Uno-Dos.mp4") == (0, "DRY_RUN") and (videos / "Demo-Uno-Dos.mp4").exists()
    assert delete("Demo-Uno-Dos.mp4", "--yes") == (0, "DELETE") and not (videos / "Demo-Uno-Dos.mp4").exists()
    assert delete("Demo-Uno-Dos.mp4", "--yes") == (0, "SKIP_ABSENT")
    got = {x["video"]: x for x in call("record-videos", *folders)[1]}
    assert got["Demo-Uno-Dos.mp4"]["eliminado"] and got["Demo-Uno-Dos.mp4"]["registrado"] == demo["registrado"]
