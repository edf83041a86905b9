from pyspark.sql import functions as F

from fieldbook.functions import scalars as S


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_cleaning(spark):
    assert one(spark, S.clean_cat("a"), a=" COMMUNAL   X ") == "COMMUNAL X"
    assert one(spark, S.clean_cat("a"), a=None) == ""
    assert one(spark, S.normalize_status("a"), a="Transfered :UI( x )") == "Transferred"
    assert one(spark, S.normalize_status("a"), a="") == "Unknown"
    flag = S.normalize_flag("a", "non", "heinous", "Non-Heinous", "Heinous")
    assert [one(spark, flag, a=x) for x in ("Non Heinous", "heinous", "other", "")] == ["Non-Heinous", "Heinous", "other", "Unknown"]
    assert [one(spark, S.to_count("a"), a=x) for x in ("3", "abc", "-2", "", None)] == [3, 0, 0, 0, 0]


def test_dates(spark):
    day = S.date_of("y", "m", "d")
    assert one(spark, day, y=2024, m=2, d=30) is None
    assert one(spark, S.day_of_week(day), y=2024, m=2, d=30) == -1
    assert one(spark, S.day_of_week(day), y=2024, m=1, d=1) == 0
    assert [one(spark, S.season("m"), m=m) for m in (1, 4, 9, 11, None)] == ["Winter", "Summer", "Monsoon", "Post-Monsoon", "Unknown"]
    assert one(spark, S.partial_flag("y", 2001), y=None) == 0


def test_coordinates(spark):
    box = (11.0, 19.0, 73.0, 79.0)
    place = S.valid_coord("a", "b", box)
    got = [tuple(one(spark, place, a=a, b=b)) for a, b in (("0", "0"), ("76", "15"), ("15", "76"), ("1", "2"), ("x", "76"))]
    assert got == [(None, None), (15.0, 76.0), (15.0, 76.0), (None, None), (None, None)]


def test_citations(spark):
    def parse(text):
        p = one(spark, S.parse_citations("t"), t=text)
        return list(p["acts"]), [tuple(x) for x in p["pairs"]], p["first_act"], p["first_section"]

    assert parse("") == ([], [], "", "")
    assert parse(None) == ([], [], "", "")
    assert parse("ROAD CODE 1901,") == (["ROAD CODE 1901,"], [], "ROAD CODE 1901,", "")
    acts, pairs, act, section = parse("ROAD CODE U/s: 12,40(B)  FIRE  ACT U/s: 7(c&d)")
    assert acts == ["ROAD CODE", "FIRE ACT"]
    assert pairs == [("ROAD CODE", "12"), ("ROAD CODE", "40(B)"), ("FIRE ACT", "7(c&d)")]
    assert (act, section) == ("ROAD CODE", "12")
    acts, pairs, *_ = parse("A U/s: 1 A U/S : 2")
    assert acts == ["A"] and pairs == [("A", "1"), ("A", "2")]
    # No act at all; blanks between sections; words behind the last; commas at the end of names; a middle segment without a name.
    assert parse("U/s: 12,13") == ([], [("", "12"), ("", "13")], "", "12")
    assert parse("A U/s: 12 40(B)") == (["A"], [("A", "12"), ("A", "40(B)")], "A", "12")
    assert parse("A U/s: 12,13 and more words") == (["A"], [("A", "12"), ("A", "13")], "A", "12")
    assert parse("A,, U/s: 5 B, U/s: 6,") == (["A", "B"], [("A", "5"), ("B", "6")], "A", "5")
    assert parse("A U/s: 1 U/s: 2 C U/s: 3")[:2] == (["A", "C"], [("A", "1"), ("C", "2"), ("C", "3")])
    assert parse("A u/s: 1") == (["A u/s: 1"], [], "A u/s: 1", "")
    assert len(parse("A U/s: " + ",".join(map(str, range(9000))))[1]) == 9000


def test_suffix_names_and_rates(spark):
    assert tuple(one(spark, S.extract_suffix_code("a"), a="A B EXAMPLE   (P.I)")) == ("A B EXAMPLE", "PI")
    assert tuple(one(spark, S.extract_suffix_code("a"), a="NOBODY")) == ("NOBODY", "")
    assert one(spark, S.norm_name("a", ["DISTRICT"]), a="São  Paulo-District 1") == "SAO PAULO 1"
    assert one(spark, S.safe_rate("a", "b"), a=1, b=0) == 0.0
    assert one(spark, S.rounded(F.lit(1.005), 2)) == 1.01
    assert one(spark, S.first_match("a", [("night", "late", "said"), ("nig", "early", "said")], ("none", "-")), a="NIGHT shift")["bucket"] == "late"
