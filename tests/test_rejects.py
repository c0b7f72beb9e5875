from seqspark.operators.rejects import failed, loaded, parse_rows


def good(c0="7", c1="s", c11="99.5"):
    return "\t".join([c0, c1, "90.0", "10", "1", "0", "1", "10", "5", "14", "1e-9", c11])


CASES = [
    (good(), None),
    (good() + "\r", None),
    (good() + "\r\r", None),
    (good("007"), None),
    (good(" 8 "), None),
    (good('" 8 "'), None),
    (good("0"), "value"),
    (good("+5"), "value"),
    (good("３"), "value"),
    (good("1.0"), "value"),
    (good(""), "value"),
    (good("123456789012345678901"), None),
    (good(c11="1.2e2"), None),
    (good(c11="1e999"), "value"),
    (good(c11="inf"), "value"),
    (good(c11="-1"), "value"),
    (good(c11="-0.0"), None),
    (good(c11=".5"), None),
    (good(c11="5."), None),
    (good(c11="NaN"), "value"),
    (good(c1='"a\tb"'), None),
    (good(c1='"a""b"'), None),
    (good(c1='""'), None),
    (good(c1='""""'), None),
    (good(c1='a"b'), "quoting"),
    (good(c1='"a'), "quoting"),
    (good(c1='"a"b'), "quoting"),
    (good(c1=' "a"'), "quoting"),
    (good(c1='"a\u0001b\tc"'), None),
    (good() + "\tx", "columns"),
    ("a\tb", "columns"),
    ('a"\tb', "quoting"),
    ("x" * 200_000, "columns"),
    (good(c1='"' + '""' * 50_000 + '"'), None),
]
SKIPPED = ["", "   ", "\t", "\r", "# 1\t2", "#", None, " "]


def test_reasons_and_types(spark):
    lines = [c[0] for c in CASES] + SKIPPED
    df = spark.createDataFrame([(i, x, "own", "other") for i, x in enumerate(lines)], "line_id int, line string, C1 string, reason string")
    parsed = parse_rows(df)
    assert {r["line_id"]: r["reason"] for r in parsed.collect()} == {i: c[1] for i, c in enumerate(CASES)}
    bad = {r["line_id"] for r in failed(parsed).collect()}
    rows = {r["line_id"]: r for r in loaded(parsed).collect()}
    assert bad | set(rows) == set(range(len(CASES))) and not bad & set(rows)
    assert [rows[i]["c1"] for i in (20, 21, 22, 23, 28)] == ["a\tb", 'a"b', "", '"', "a\u0001b\tc"]
    assert (rows[0]["c0"], rows[0]["c2"], rows[0]["c8"], rows[0]["c11"]) == (7, 90.0, 5, 99.5)


def test_shuffled_dictionary_gives_the_same(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)] * 3, "line_id int, line string")
    a = sorted((r["line_id"], r["reason"] or "") for r in parse_rows(df).collect())
    b = sorted((r["line_id"], r["reason"] or "") for r in parse_rows(df, broadcast_mb=0).collect())
    assert a == b and len(a) == 3 * len(CASES)


def test_empty_table(spark):
    df = spark.createDataFrame([], "line_id int, line string")
    assert failed(parse_rows(df)).count() == 0 and loaded(parse_rows(df)).count() == 0
