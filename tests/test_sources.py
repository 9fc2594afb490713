import csv
import random

import pytest

from datasonde.functions.fixed_values import CSV_MISSING_TOKENS
from datasonde.functions.kinds import column_infos
from datasonde.functions.shared import shared_folder
from datasonde.operators.columns import per_column
from datasonde.sources import parts as P
from datasonde.sources import sinks as K
from datasonde.sources import tables as S
from datasonde.sources.records import csv_records


@pytest.fixture(scope="module")
def parts(make, spark):
    jan = make("id long, score double", id=[1, 2], score=[10.0, 20.0])
    feb = make("id long, score double", id=[3, 4], score=[30.0, 40.0])
    return {"Jan": jan, "Feb": feb, "Blank": spark.createDataFrame([], jan.schema)}


def test_parts_are_combined_with_their_origin(parts):
    combined, warnings = P.combine_parts(parts)
    assert combined.columns == ["sheet", "id", "score"]
    assert sorted((r["sheet"], r["id"]) for r in combined.collect()) == [("Feb", 3), ("Feb", 4), ("Jan", 1), ("Jan", 2)]
    assert warnings == ["skipped empty part 'Blank'", "combined 2 parts: Jan, Feb"]


def test_budget_runs_across_parts(parts):
    combined, _ = P.combine_parts(parts, max_rows=2)
    assert combined.count() == 3


def test_a_single_part_keeps_its_columns(parts):
    combined, warnings = P.combine_parts({"Jan": parts["Jan"], "Blank": parts["Blank"]})
    assert combined.columns == ["id", "score"] and warnings == ["skipped empty part 'Blank'"]


def test_an_origin_column_of_the_data_is_kept(parts):
    named = {n: parts[n].selectExpr("'mine' as sheet", "id") for n in ("Jan", "Feb")}
    combined, _ = P.combine_parts(named)
    assert {r["sheet"] for r in combined.collect()} == {"mine"}


def test_parts_that_cannot_be_combined(parts):
    with pytest.raises(S.LoadError, match="different columns"):
        P.combine_parts({"A": parts["Jan"], "B": parts["Feb"].select("score", "id")})
    with pytest.raises(S.LoadError, match="no data"):
        P.combine_parts({"Blank": parts["Blank"]})


def test_part_selection(parts):
    assert P.select_part(parts, "Feb").count() == 2
    assert {r["id"] for r in P.select_part(parts, 0).collect()} == {1, 2}
    assert {r["id"] for r in P.select_part(parts, "-2").collect()} == {3, 4}
    assert P.resolve_part(["a", "0"], "0") == "0"  # a name beats an index
    for wanted, said in (("Mar", "not found"), (9, "out of range"), ("Blank", "is empty")):
        with pytest.raises(S.LoadError, match=said):
            P.select_part(parts, wanted)


def test_parts_from_files(spark, parts, tmp_path):
    for name in ("Jan", "Feb"):
        parts[name].write.parquet(str(tmp_path / name))
    read = P.read_parts(spark, {name: str(tmp_path / name) for name in ("Jan", "Feb")})
    combined, _ = P.combine_parts(read)
    assert P.list_parts(read) == ["Jan", "Feb"] and combined.count() == 4


def test_csv_types_and_missing_tokens(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,score,grade,ok,joined,code\n1,1.5,A,True,2024-01-01,n/a\n2,NA,B,False,2024-01-02,7\n3,3,,True,,007\n4,4e2,\"x, \"\"y\"\"\",True,2024-01-04,NULL\n")
    df = S.infer_datetimes(S.read_table(spark, str(path)))
    assert dict(df.dtypes) == {"id": "bigint", "score": "double", "grade": "string", "ok": "boolean", "joined": "timestamp_ntz", "code": "bigint"}
    rows = df.orderBy("id").collect()
    assert [r["score"] for r in rows] == [1.5, None, 3.0, 400.0]
    assert [r["grade"] for r in rows] == ["A", "B", None, 'x, "y"']
    assert [r["code"] for r in rows] == [None, 7, 7, None]


def test_csv_integers_keep_their_digits(spark, tmp_path):
    path = tmp_path / "ids.csv"
    ids = [9223372036854775806, 9223372036854775805, -9223372036854775808]
    path.write_text("id,wide,huge\n" + "".join(f"{i},{i * 1000},{i}{'0' * 30}\n" for i in ids))
    df = S.read_csv(spark, str(path))
    assert dict(df.dtypes) == {"id": "bigint", "wide": "decimal(38,0)", "huge": "double"}
    assert {r["id"] for r in df.collect()} == set(ids) and {int(r["wide"]) for r in df.collect()} == {i * 1000 for i in ids}


def test_csv_rows_that_are_too_long_or_unclosed_are_errors(spark, tmp_path):
    long, torn, short = (tmp_path / f"{n}.csv" for n in ("long", "torn", "short"))
    long.write_text("a,b\n1,2\n3,4,5\n6,7,\n")
    with pytest.raises(S.LoadError, match=r"1 row\(s\) with more cells than the 2"):
        S.read_csv(spark, str(long))
    torn.write_text('a,b\n1,"two\nlines"\n2,plain\n')
    for whole_files in (False, True):
        rows = S.read_csv(spark, str(torn), multi_line=whole_files).orderBy("a").collect()
        assert [tuple(r) for r in rows] == [(1, "two\nlines"), (2, "plain")]
    torn.write_text('a,b\n1,"two\nlines\n2,plain\n')
    with pytest.raises(S.LoadError, match="ends inside a quoted cell"):
        S.read_csv(spark, str(torn))
    short.write_text("a,b\n1\n2,x\n")
    assert [tuple(r) for r in S.read_csv(spark, str(short)).orderBy("a").collect()] == [(1, None), (2, "x")]


def torn_rows(n, seed):
    rng = random.Random(seed)
    bits = ["a", "b,c", '"', "\n", "\n\n", "x y", "\r\n", '5" pipe', "", ",\"", "1"]
    return [[str(i), "".join(rng.choice(bits) for _ in range(rng.randint(0, 6))), rng.choice(["k", 'q"', "v\nw"])] for i in range(n)]


def test_csv_line_breaks_are_read_from_all_splits(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    wanted = set()
    for part in range(3):
        rows = [[f"{part}-{i}", *rest] for i, *rest in torn_rows(400, part)]
        wanted |= {tuple(r) for r in rows}
        with open(folder / f"{part}.csv", "w", newline="") as out:
            out.write("\n" * part)
            csv.writer(out, lineterminator=("\n", "\r\n")[part % 2]).writerows([["id", "some\ntext", "kind"], *rows])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        records = csv_records(spark, str(folder))
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 5
        df = S.read_csv(spark, str(folder))
        assert df.columns == ["id", "some\ntext", "kind"]
        missing = {t for t in CSV_MISSING_TOKENS}
        assert {tuple(r) for r in df.collect()} == {tuple(None if c in missing else c for c in r) for r in wanted}
        assert records.count() == 1200
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_cells_longer_than_a_split(spark, tmp_path):
    long, bare = tmp_path / "long.csv", tmp_path / "bare.csv"
    text = "\n".join(f'line {i}, ""said"", {"x" * (i % 7)}' for i in range(400))
    long.write_text(f'a,b\n1,"{text}"\n2,plain\n3,"{text}"\n4,"{text}"\n')
    bare.write_text('"a\nb",c\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        rows = S.read_csv(spark, str(long)).orderBy("a").collect()
        cell = text.replace('""', '"')
        assert [tuple(r) for r in rows] == [(1, cell), (2, "plain"), (3, cell), (4, cell)]
        empty = S.read_csv(spark, str(bare))
        assert empty.columns == ["a\nb", "c"] and empty.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_the_type_pass_reads_a_wide_text_once(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text(",".join(f"c{i}" for i in range(130)) + "\n" + ",".join("1" for _ in range(130)) + "\n")
    df = S.read_csv(spark, str(path))
    assert {t for _, t in df.dtypes} == {"bigint"}
    infos = column_infos(df)
    plan = per_column(df, infos, lambda c: {"n": f"count({c.value})"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_other_suffixes_are_refused(spark):
    with pytest.raises(S.LoadError, match="neither .csv nor .parquet"):
        S.read_table(spark, "/nowhere/book.xlsx")


def test_parts_of_a_folder_know_their_file(spark, parts, tmp_path):
    parts["Jan"].coalesce(1).write.parquet(str(tmp_path / "all"))
    parts["Feb"].coalesce(1).write.mode("append").parquet(str(tmp_path / "all"))
    df = P.read_part_folder(spark, str(tmp_path / "all"))
    assert df.columns == ["sheet", "id", "score"]
    assert sorted(r["count"] for r in df.groupBy("sheet").count().collect()) == [2, 2]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Remote:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Remote()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
    Remote.master = "local[2]"
    assert shared_folder(Session())


def test_unreadable_files(spark):
    for path in ("/nowhere/x.csv", "/nowhere/x.parquet"):
        with pytest.raises(S.LoadError, match="could not load"):
            S.read_table(spark, path)


def test_datetimes_convert_only_without_loss(make):
    days = [f"2024-01-{d:02d}" for d in range(1, 21)]
    df = make(
        "a string, b string, c string, d string, e string",
        a=[*days, "not a date"],
        b=[*days, None],
        c=["2024-01-01T10:00:00+02:00"] * 20 + [None],
        d=["2024-01-01T10:00:00+02:00"] * 20 + ["2024-01-01T10:00:00Z"],
        e=[None] * 21,
    )
    typed = S.infer_datetimes(df)
    assert dict(typed.dtypes) == {"a": "string", "b": "timestamp_ntz", "c": "timestamp", "d": "string", "e": "string"}
    assert typed.where("b is null").count() == 1


def test_mixed_iso_forms_convert(make):
    df = make("d string", d=["2024-01-01", "2024-01-01 10:00", "20240102", "2024-01-02T03:04:05.123456"])
    typed = S.infer_datetimes(df)
    assert typed.dtypes == [("d", "timestamp_ntz")] and typed.where("d is null").count() == 0


def test_guards(spark):
    assert S.check_input(spark.range(3)) is None
    assert S.check_input(spark.range(0)) == "input contains no data rows"
    assert S.check_input(spark.range(3).select()) == "input contains no columns"
    assert S.check_input(spark.range(3), max_rows=2) == "input has more than 2 rows"
    assert S.check_input(spark.range(3), max_rows=3) is None


def test_byte_guard(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert S.input_bytes(df) > 1000
    assert "limit" in S.check_input(df, max_bytes=100)


def test_preview_follows_the_key(spark):
    assert [r["id"] for r in S.preview(spark.range(500).repartition(5), ["id"]).collect()] == list(range(100))


def test_profile_is_written_once_per_run(spark, tmp_path):
    df = spark.range(30).selectExpr("id", "if(id % 3 = 0, null, 'x') as s")
    tables = K.profile_tables(df, order_by=["id"])
    assert {"shape", "missing", "moments", "pearson", "health", "insights", "recommendations"} <= set(tables)
    assert {"quantiles", "modes", "column_types", "summaries", "sample", "empty_rows", "co_missing", "outlier_examples"} <= set(tables)
    assert [r["id"] for r in tables["sample"].collect()] == ["0", "1", "2", "3", "4"]
    assert tables["quantiles"].first()["median"] == 14.5 and tables["empty_rows"].first()["rows_with_missing"] == 10
    some = {k: tables[k] for k in ("shape", "missing", "health")}
    written = K.write_profile(some, str(tmp_path / "p"), run_id="1")
    assert len(written) == 3 and spark.read.json(written[0]).first()["n_rows"] == 30
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        K.write_profile(some, str(tmp_path / "p"), run_id="1")
    K.write_profile(some, str(tmp_path / "p"), run_id="2")


def test_shared_folder_is_the_cluster_one(spark):
    assert shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
