"""op2: weak candidates that contain or cross a base span."""

from siltstone.llm import secrets


def test_endpoint_around_a_base_span_is_linked(spark):
    url, key = "https://host.example/acct/" + "0af" * 9, "Ab1" * 14
    texts = {
        1: f"{url} {key}", 2: url, 3: f"https://host.example/x?token=abcdef12 then {key}",
        4: f"token=login=bob99xyz {key}", 5: f"https://host.example/x?token=abcdef12 and password: hunter2hunter",
    }
    found = secrets.find_secrets(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    linked = {r["doc_id"]: [(secrets.KINDS[s["kind"]], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["linked"]] for r in found.collect()}
    assert linked[1] == [("endpoint", url), ("key", key)] and linked[2] == []
    assert linked[3] == [("endpoint", texts[3].split()[0]), ("key", key)]
    assert linked[4] == [("key", key)]
    assert linked[5] == [("endpoint", texts[5].split()[0])]
