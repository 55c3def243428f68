"""Disclosed terms are spanned in the whole of every document that holds their entity."""

import random

from panelspark.llm import pii


def test_terms_far_from_their_entity_are_spans_too(spark):
    rng = random.Random(3)
    say = lambda n: " ".join("w%d" % rng.randrange(300) for _ in range(n))
    docs = [(i, say(60)) for i in range(200)]
    for i in range(0, 40, 4):
        docs[i] = (i, f"{say(10)} Zarathustrix {say(2)} zara.t@mail.example.com {say(10)}")
    docs += [(300, f"zara.t@mail.example.com {say(40)} Zarathustrix {say(9)}"), (301, f"zara.t@mail.example.com {say(40)}")]
    rows, terms = pii.sanitise(spark.createDataFrame(docs, "doc_id long, text string"), pii.DisclosureRule(threshold=0.8))
    assert "zarathustrix" in {r["term"] for r in terms.collect()}
    spans = {r["doc_id"]: [x for x in r["spans"].split(",") if x.startswith("term")] for r in rows.collect()}
    at = docs[200][1].index("Zarathustrix")
    assert f"term:{at}:{at + 12}" in spans[300] and not any(docs[201][1][int(x.split(":")[1]):int(x.split(":")[2])].lower() == "zarathustrix" for x in spans[301])
