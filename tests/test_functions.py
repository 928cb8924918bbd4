import datetime as dt

import pytest
from pyspark.sql import functions as F

from kinfold.functions import dates, ids, paths, phonetic, setsim, text
from kinfold.functions.phonetic import codes, double_metaphone


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def tokens(spark, name, value):
    c = text.ANALYZERS[name].token_set(F.col("s"))
    return set(spark.createDataFrame([(value,)], "s string").select(c).first()[0])


@pytest.mark.parametrize("value", ["P.O. BOX 1234", "PO BOX 1234", "P O BOX 1234", "P.O.BOX 1234"])
def test_post_boxes(spark, value):
    assert tokens(spark, "street_tokens", value) == {"pobox", "1234"}


@pytest.mark.parametrize(
    "value, found",
    [
        ("100 MAIN ST", {"100", "main", "street"}),
        ("100 MAIN STREET", {"100", "main", "street"}),
        ("100 RTE 9", {"100", "route", "9"}),
        ("100 MAIN PL", {"100", "main", "place"}),
        ("100 MAIN ST NW", {"100", "main", "street", "northwest"}),
        ("100 MAIN ST STE 200", {"100", "main", "street", "200"}),
        ("100 MAIN ST UNIT 200", {"100", "main", "street", "200"}),
        ("100 MAIN ST #200", {"100", "main", "street", "200"}),
        ("100 1ST AVE", {"100", "1st", "avenue"}),
        ("100 FIRST AVE", {"100", "first", "avenue"}),
        (None, set()),
        ("  ", set()),
    ],
)
def test_streets(spark, value, found):
    assert tokens(spark, "street_tokens", value) == found


def test_names_fold_and_stop(spark):
    assert tokens(spark, "name_clean", "École Straße") == {"ecole", "strasse"}
    assert tokens(spark, "name_phonetic", "TRUCKING LLC") == set()
    assert tokens(spark, "phone_clean", "(555) 123-4567") == {"5551234567"}
    assert tokens(spark, "street_clean", "100  Main St.") == {"100 main st"}


def test_double_metaphone():
    assert set(codes("SMITH")) == set(codes("SMYTH")) == {"SM0", "XMT"}
    assert set(codes("SCHMIDT")) == {"XMT", "SMT"}
    assert codes("200") == ["200"]
    assert double_metaphone("") == ("", "")


def test_double_metaphone_equals_the_library(spark):
    codec = spark.sparkContext._jvm.org.apache.commons.codec.language.DoubleMetaphone()
    codec.setMaxCodeLen(6)
    for w in "ACCIDENT BACCHUS CAESAR CHIANTI MICHAEL CZERNY EDGE DANGER GYPSY BIAGGI CABRILLO CAMPBELL SUGAR VISION SCHOONER NATION THOMAS FILIPOWICZ BREAUX ZHAO JOSE WRIGHT LAUGH THUMB".split():
        assert double_metaphone(w) == (codec.doubleMetaphone(w), codec.doubleMetaphone(w, True)), w


def test_join_keys(spark):
    rows = [("23680",), ("00023680",), ("3240797.0",), ("0",), (None,), (" 12",), ("X1",), ("",)]
    assert [r[0] for r in values(spark, rows, "s string", text.normalize_join_key(F.col("s")))] == ["23680", "23680", "3240797", "0", None, " 12", "X1", ""]


def test_dates(spark):
    cases = {"2021-02-28": "2021-02-28", "2021-02-29": None, "01-JUN-74": "1974-06-01", "1-jun-21": "2021-06-01", "20210203": "2021-02-03", "2021-W01-1": "2021-01-04", "2020-W53-5": "2021-01-01", "2021-W53-1": None, "9999-99-99": None, "2021-2-9": None, "junk": None, "": None, None: None}
    got = values(spark, [(k,) for k in cases], "s string", dates.parse_flexible_date(F.col("s")))
    assert [r[0].isoformat() if r[0] else None for r in got] == list(cases.values())
    got = values(spark, [("31-FEB-21",), ("01-JUN-31",), ("01-JUN-30",), ("20210203",)], "s string", dates.legacy_date_iso(F.col("s")))
    assert [r[0] for r in got] == [None, "1931-06-01", "2030-06-01", None]
    got = values(spark, [(["2020-01-01", "junk", "2021-05-01"],), ([],), (None,)], "a array<string>", dates.latest_date(F.col("a"), True))
    assert [r[0] for r in got] == [dt.date(2021, 5, 1), None, None]
    assert values(spark, [("2021-02-03T01",)], "s string", dates.to_yyyymmdd(F.col("s"))) == [(20210203,)]


def test_set_similarity_keeps_null_and_zero_apart(spark):
    rows = [(["a", "b"], ["b", "c"]), (["a"], ["b"]), ([], ["a"]), (None, ["a"])]
    got = values(spark, rows, "a array<string>, b array<string>", setsim.jaccard(F.col("a"), F.col("b")), setsim.containment(F.col("a"), F.col("b")), setsim.blended_overlap(F.col("a"), F.col("b")))
    assert got[0] == pytest.approx((1 / 3, 0.5, 5 / 12))
    assert got[1] == (0.0, 0.0, 0.0)
    assert got[2] == got[3] == (0.0, 0.0, None)


def test_phones(spark):
    rows = [("(555) 123-4567",), ("999-9999",), ("12",), (None,)]
    assert [r[0] for r in values(spark, rows, "s string", text.normalize_phone(F.col("s")))] == ["5551234567", None, None, None]


def test_paths_through_two_arrays(spark):
    df = spark.createDataFrame([([{"u": [{"v": "a"}, {"v": None}]}, {"u": None}, {"u": [{"v": "b"}]}],), (None,)], "i array<struct<u array<struct<v string>>>>")
    assert [r[0] for r in df.select(paths.read_values(df, "i.u.v")).collect()] == [["a", "b"], []]
    assert df.select(paths.read_path(df, "i.nope")).first()[0] is None
    odd = spark.createDataFrame([("x",)], "`a.b` string")
    assert odd.select(paths.read_path(odd, "a.b")).first()[0] == "x"


def test_ids(spark):
    df = spark.createDataFrame([("007", "a"), (None, "b"), (" ", None)], "k string, z string")
    got = [r[0] for r in df.select(ids.document_id(df, ["k", "z"])).collect()]
    assert got[:2] == ["007|a", "|b"] and got[2].startswith("blank-key:")
    swapped = df.select("z", "k")
    assert [r[0] for r in swapped.select(ids.document_id(swapped, ["k", "z"])).collect()] == got
    assert [r[0] for r in df.select(ids.document_id(df, "k")).collect()][0] == "007"
    with pytest.raises(ValueError):
        ids.document_id(df, "missing")


def test_fingerprint_follows_analyzers_and_bindings():
    a = {"name_clean": text.ANALYZERS["name_clean"]}
    b = [text.Binding("n", {"clean": "name_clean"})]
    assert text.fingerprint(a, b) == text.fingerprint(dict(a), list(b)) != text.fingerprint(a, [text.Binding("n", {"x": "name_clean"})])
    assert text.fingerprint({}, []) is None


@pytest.mark.parametrize("most", [200_000, 3, 2])
def test_codec_encoders(spark, most):
    """Golden codes, by a broadcast map and by the join that a larger vocabulary takes."""
    df = spark.createDataFrame([(1, ["SMITH", "SCHMIDT", "12"]), (2, None), (3, []), (4, ["Thompson", "Knight"]), (5, ["SMITH"])], "k int, t array<string>")
    coded = lambda kind: {r["k"]: r["t"] for r in phonetic.encode_column(df, "t", kind, most).collect()}
    assert coded("metaphone") == {1: ["SM0", "SKMT", "12"], 2: None, 3: [], 4: ["0MPS", "NT"], 5: ["SM0"]}
    assert coded("beider_morse") == {1: ["zmit", "zmit", "12"], 2: None, 3: [], 4: ["tompson", "knigt", "knigxt"], 5: ["zmit"]}
    with pytest.raises(ValueError):
        phonetic.encode_column(df, "t", "nonsense", most).collect()


def test_vocabulary_goes_through_in_batches(spark):
    words = spark.range(25).select(F.concat(F.lit("smith"), F.col("id").cast("string")).alias("t"))
    got = {r["t"]: r["c"] for r in phonetic.code_table(words, "metaphone", 10).collect()}
    assert len(got) == 25 and set(map(tuple, got.values())) == {("SM0",)}


@pytest.mark.parametrize("value, folded", [("ﬁn ＡＢＣ １２ ℡", "fin abc 12 tel"), ("Straße ẞ", "strasse ss"), ("Ørsted Łódź Æon Œuvre Đình Þór", "orsted lodz aeon oeuvre dinh thor"), ("ΣΊΣΥΦΟΣ", "σισυφοσ"), ("naïve Ångström", "naive angstrom"), (None, None), ("", "")])
def test_full_folding(spark, value, folded):
    assert spark.createDataFrame([(value,)], "s string").select(text.fold(F.col("s"))).first()[0] == folded
