"""The secret stage masks what looks live and leaves copied examples."""

import corpus_pipeline
from tidemark.llm import secrets

SHARED, OWN, INNER = "AKIA" + "E" * 16, "AKIA" + "L" * 16, "gh" + "p_" + "z" * 36


def test_stage_takes_verdicts_over_all_documents(spark):
    rows = [(i, f"é key {SHARED} end", "en", f"s{i}", 1) for i in range(secrets.EXAMPLE_OWNERS)]
    rows += [
        (10, f"é {OWN} and {SHARED} then token = \"{INNER}\" x", "en", "s0", 2),
        (11, f"{OWN}", "de", "s0", 3), (12, None, "en", "s1", 4), (13, "", "en", None, 5), (14, "no key", None, "s1", 6),
        (15, "password: hunter22, " + "ab" * 15, "en", "s2", 7), (15, "password: hunter22", "en", "s2", 8), (None, "secret=qwerty99", "en", "s9", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.mask_secrets(spark, df, "")
    assert out.columns == df.columns
    got = {r.n_chars: r.text for r in out.filter("n_chars > 1").collect()}
    assert got == {
        2: f"é [SECRET] and {SHARED} then token = \"[SECRET]\" x", 3: "[SECRET]", 4: None, 5: "", 6: "no key",
        7: "password: [SECRET], [SECRET]", 8: "password: [SECRET]", 9: "secret=[SECRET]",
    }
    assert [r.text for r in out.filter("n_chars = 1").collect()] == [rows[0][1]] * secrets.EXAMPLE_OWNERS
