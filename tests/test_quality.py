import pytest

from datasonde.operators import health as H
from datasonde.operators import quality as Q
from datasonde.operators.columns import missing_counts


def found(df):
    return {(r["check"], r["column"]) for r in Q.quality_issues(df).collect()}


def test_each_flaw_is_named_at_its_column_only(make):
    df = make(
        "weight string, city string, plan string, due string, stock int, price double, note string",
        weight=["12.5", "1,040", "-7", "8e2", "unknown", "3"],
        city=["Lima", "Oslo ", "Kyoto", "\tQuito", "Lima", "Oslo "],
        plan=["gold", "Gold", "tin", "tin", "GOLD", "zinc"],
        due=["03/11/2021", "14 Feb 2022", "2020-06-30", "July 1, 2019", "soon", "2023/05/05"],
        stock=[40, -9999, 0, 17, 23, -9999],
        price=[1.0, 2.0, 3.0, 5.0, 8.0, 13.0],
        note=["first", "second", "third", "fourth", "fifth", "sixth"],
    )
    assert found(df) == {
        ("numeric_as_text", "weight"),
        ("sentinels", "weight"),
        ("whitespace", "city"),
        ("mixed_case", "plan"),
        ("dates_as_text", "due"),
        ("numeric_sentinel", "stock"),
    }


def test_unicode_whitespace_is_stripped(make):
    df = make("s string", s=[" x", "x ", "\ty\n", "z"])
    row = Q.text_issues(df, "whitespace").first()
    assert (row["hits"], row["total"]) == (3, 4)


@pytest.mark.parametrize("text, number", [("1,234.5", True), ("-3", True), ("1e5", True), ("inf", True), (".5", True), ("1d", False), ("1_000", False), ("nan", False), ("", False), ("12 Main", False)])
def test_what_reads_as_a_number(make, text, number):
    row = Q.text_counts(make("s string", s=[text])).first()
    assert row["n_numbers"] == int(number)


@pytest.mark.parametrize(
    "text, date",
    [
        ("2024-01-05", True), ("20240105", True), ("2024-01-05T10:30:00Z", True), ("01/02/2024", True), ("13/01/2024", True),
        ("5 Jan 2024", True), ("05-Jan-2024", True), ("January 5, 2024", True), ("2024/01/05", True), ("1995-02-30", False),
        ("12345", False), ("1-URGENT", False), ("10.0.0.1", False), ("555-12-3456", False), ("monday", False),
    ],
)
def test_what_reads_as_a_date(make, text, date):
    assert Q.text_counts(make("s string", s=[text])).first()["n_dates"] == int(date)


def test_long_texts_differ_only_past_the_key(make):
    head = "Aa" * 400
    assert found(make("s string", s=[head + "X", head + "x"])) == {("mixed_case", "s")}
    assert found(make("s string", s=[head + "X", head + "Y"])) == set()


def test_tables_without_text_or_values(make):
    assert found(make("a int, b string", a=[1, 2], b=[None, None])) == set()
    assert found(make("a int", a=[1, -9999])) == {("numeric_sentinel", "a")}
    assert Q.pii_scan(make("a int", a=[1, 2, 3])).collect() == []


def test_pii(make):
    df = make(
        "contact string, host string, payment string, ward string, sparse string",
        contact=["ola.nord@mail.example", "k+7@b.example.org", "no address", "t_9@c.example", "x@d.example"],
        host=["127.0.0.1", "192.0.2.44", "198.51.100.7", "203.0.113.300", "255.255.255.255"],
        payment=["5500 0000 0000 0004", "3400-0000-0000-009", "6011000000000004", "paid in cash", "30"],
        ward=["north", "south", "east", "west", "centre"],
        sparse=["z@e.example", "y@f.example", None, None, None],
    )
    got = {r["column"]: (r["kind"], r["cnt"], r["pct"]) for r in Q.pii_scan(df).collect()}
    assert got == {"contact": ("email", 4, 80.0), "host": ("ip_address", 4, 80.0), "payment": ("credit_card", 3, 60.0)}


def test_pii_needs_a_majority(make):
    assert Q.pii_scan(make("s string", s=["w@g.example", "w at g", "w.g.example", "@", "g"])).collect() == []


def test_health_of_a_clean_table(make):
    row = H.health_score(make("a int, b string", a=[1, 2, 3], b=["x", "y", "z"])).first()
    assert (row["score"], row["grade"]) == (100, "A")
    assert row["verdict"] == "Grade A (100/100): no duplicates, missing values, or quality issues detected."


def test_health_blends_average_and_worst_missingness(make):
    df = make("a int, b int, c int, d int", a=[1, 2, 3, 4], b=[1, None, None, None], c=[1, 2, 3, 4], d=[5, 6, 7, 8])
    assert H.completeness(missing_counts(df)).first()["score"] == pytest.approx(100 - (18.75 + 75) / 2)


@pytest.mark.parametrize("missing, score, grade", [(25.0, 90, "A"), (27.5, 89, "B"), (50.0, 80, "B"), (75.0, 70, "C"), (100.0, 60, "D"), (102.5, 60, "D")])
def test_grades(spark, missing, score, grade):
    """A single column, so completeness falls by its missing share and weighs 40 %."""
    tables = {
        "missing": spark.createDataFrame([(0, "c", missing)], "position int, column string, pct_missing double"),
        "dups": spark.createDataFrame([(100, 0)], "n_rows long, duplicate_rows long"),
        "issues": spark.createDataFrame([], "check string, column string"),
        "constants": spark.createDataFrame([], "column string"),
    }
    row = H.health_of(tables["missing"], tables["dups"], tables["issues"], tables["constants"], 1).first()
    assert (row["score"], row["grade"]) == (score, grade)


def test_verdict_cites_only_what_was_found(spark):
    missing = spark.createDataFrame([(0, "age", 18.0), (1, "b", 0.0)], "position int, column string, pct_missing double")
    dups = spark.createDataFrame([(100, 45)], "n_rows long, duplicate_rows long")
    issues = spark.createDataFrame([("whitespace", c) for c in "abcdefg"], "check string, column string")
    row = H.health_of(missing, dups, issues, spark.createDataFrame([], "column string"), 12).first()
    assert row["verdict"].endswith("45 duplicate rows, 7 of 12 columns with quality issues, worst missingness `age` at 18%.")
    assert row["consistency"] == 0 and row["uniqueness"] == 55
