from pyspark.sql import functions as F

from larkspur.functions import stem, text as T, times, vectors as V


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def test_camel_parts(spark):
    assert one(spark, "getUserByIDHTTPServer", T.camel_parts) == ["get", "User", "By", "IDHTTP", "Server"]
    assert one(spark, "HTTPServer2Go", T.camel_parts) == ["HTTP", "Server2", "Go"]


def test_code_tokens(spark):
    got = [(t["text"], t["token_type"]) for t in one(spark, "fn get_userName(HTTP x1) A plain", T.code_tokens)]
    assert got == [("fn", "prose"), ("get", "prose"), ("user", "prose"), ("name", "code"), ("HTTP", "code"), ("x1", "code"), ("a", "mixed"), ("plain", "prose")]


def test_is_code_line(spark):
    for line, want in [("def f(x):", True), ("    x = 1", True), ("});", True), ("Plain words here.", False), ("", False), ("}", True), ("function go", True), ("This function parses data.", False), ("see [1] here", True), ("let mut x", True), ("a match made", True), ("one, two (three)", True), ("one (two", False), ("word)", True), ("class of 1999", False), ("a == b", False)]:
        assert one(spark, line, T.is_code_line) is want, line


def test_validation(spark):
    assert [one(spark, x, T.valid_tenant) for x in ("a_1", "", "a-b", None)] == [True, False, False, False]
    assert one(spark, "018f3c2e-0000-7000-8000-000000000000", T.valid_uuid) and not one(spark, "x", T.valid_uuid)
    assert [one(spark, x, T.chunk_type) for x in ("Code", "scientific", "general", "nope")] == ["code", "doc", "other", None]


def test_signature(spark):
    s = "at 0xDEADbeef 2024-01-01T10:00:00.5Z id 018f3c2e-0000-7000-8000-000000000000"
    assert one(spark, s, T.normalize_signature) == "at 0x... <timestamp>.5Z id <uuid>"
    for text, kept in [("é" * 300, "é" * 100), ("x" + "é" * 300, "x" + "é" * 99), ("語" * 100, "語" * 66), ("a" * 201, "a" * 200), ("xy" + "😀" * 80, "xy" + "😀" * 49)]:
        assert one(spark, text, T.normalize_signature) == kept + "..."
    assert one(spark, "é" * 100, T.normalize_signature) == "é" * 100


def test_repair(spark):
    assert [one(spark, q, T.repair_query) for q in ("What's--this?", "plain", "!!!", "Two  Words")] == ["what s this", None, None, "two words"]


def test_times(spark):
    for s, ms in [("2024-01-01T00:00:00Z", 1704067200000), ("2024-01-01T02:00:00+02:00", 1704067200000), ("2024-01-01T02:00:00+0200", 1704067200000), ("2024-01-01T00:00:00.1239", 1704067200123), ("2024-13-01T00:00:00Z", None), ("2024-02-30T00:00:00Z", None), ("2024-01-01", None)]:
        assert one(spark, s, times.parse_iso) == ms, s
    assert one(spark, -5, times.format_ms, "bigint") == "-5ms"


def test_vectors(spark):
    r = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<float>, b array<float>").select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert [round(x.c, 6) for x in r] == [0.707107, 0.0, 0.0]
    pooled = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "v array<array<float>>, m array<int>").select(V.mean_pool(F.col("v"), F.col("m"))).first()[0]
    assert pooled == [2.0, 3.0]
    e = one(spark, "x", lambda c: V.mock_embedding(c, 8))
    assert abs(sum(x * x for x in e) - 1) < 1e-9 and e == one(spark, "x", lambda c: V.mock_embedding(c, 8)) != one(spark, "y", lambda c: V.mock_embedding(c, 8))


def test_stems():
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "running": "run", "hopping": "hop", "hoping": "hope", "relational": "relat", "generously": "generous", "nationally": "nation", "flies": "fli", "dying": "die", "happily": "happili", "argument": "argument", "adjustment": "adjust", "by": "by", "controlling": "control", "yelled": "yell", "consistency": "consist"}
    assert {w: stem.stem(w) for w in want} == want
