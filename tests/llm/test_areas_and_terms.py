"""No subject area and no term is left out, however many there are."""

import itertools
import string

from seqspark.llm.subjects import Terms, subjects


def test_every_area_and_term_is_kept(spark):
    garden, other = "The hedge is fine. The hedge is cut. The hedge is here.", "The choir is fine. The choir is loud. The choir is here."
    examples = spark.createDataFrame([(garden, ["garden"]), (other, ["area1"])] * 20, "body string, subjects array<string>")
    docs = spark.createDataFrame([(1, "H: x\n\n" + garden)], "doc_id int, text string")
    areas = spark.createDataFrame([(f"area{i}",) for i in range(10_000)] + [("garden",)], "subject string").coalesce(1)
    assert [tuple(r) for r in subjects(docs, examples, areas).collect()] == [(1, "garden")]

    words = ["".join(w) for w in itertools.islice(itertools.product(string.ascii_lowercase, repeat=4), 50_002)]
    half = [(" ".join(words[::2]), ["a"]), (" ".join(words[1::2]), ["b"])]
    assert Terms(half * 3, ["a", "b"]).terms == words
