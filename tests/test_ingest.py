import datetime

import pytest
from conftest import DAY, rows

from sediment.operators.diff import summary
from sediment.plans.run import run_scd2
from sediment.sources import ingest, schema
from sediment.sources.ingest import load_snapshot
from sediment.sources.store import HistoryStore

HEAD = "customer_id,name,city,tier"
META = ",effective_from,effective_to,is_current"
BASE = ["101,Mara,Lyon,Gold", "102,Ivo,Porto,Silver", "103,Tess,Ghent,Gold"]


def opened(*lines, since="2026-06-07"):
    return [f"{line},{since},,true" for line in lines]


def write(path, head, lines, newline=True):
    path.write_text("\n".join([head, *lines]) + ("\n" if newline else ""), encoding="utf-8")
    return str(path)


@pytest.fixture
def run(spark, tmp_path):
    def start(source, target=None, head=HEAD, **options):
        target = opened(*BASE) if target is None else target
        target_head = options.pop("target_head", head)
        s = write(tmp_path / "source.csv", head, source, newline=False)
        t = write(tmp_path / "target.csv", target_head + META, target)
        return run_scd2(spark, s, t, DAY, **options)

    return start


def outcome(result):
    counts = tuple(result.counts[t] for t in ("new", "changed", "unchanged", "deleted"))
    failed = {rule for rule, status in result.verdicts.items() if status == "fail"}
    return result.key, counts, result.output.count(), failed


ID = ["customer_id"]
DOUBLE = {"one_current_per_key", "no_overlapping_dates"}


def test_daily_run(run):
    result = run(["101,Mara,Nantes,Gold", BASE[1], BASE[2], "104,Olga,Riga,Bronze"])
    assert outcome(result) == (ID, (1, 1, 2, 0), 5, set())
    assert result.tracked == ["city", "name", "tier"]
    assert rows(result.output, "customer_id", "city", "effective_from", "effective_to", "is_current") == sorted(
        [
            (101, "Lyon", datetime.date(2026, 6, 7), DAY, False),
            (101, "Nantes", DAY, None, True),
            (102, "Porto", datetime.date(2026, 6, 7), None, True),
            (103, "Ghent", datetime.date(2026, 6, 7), None, True),
            (104, "Riga", DAY, None, True),
        ],
        key=repr,
    )


def test_all_new_into_a_header_only_history(run):
    result = run(BASE, target=[])
    assert outcome(result) == (ID, (3, 0, 0, 0), 3, set())
    assert dict(result.output.dtypes)["customer_id"] == "bigint"


def test_header_only_snapshot_deletes_all(run):
    result = run([])
    assert outcome(result) == (ID, (0, 0, 0, 3), 3, set())
    assert result.output.filter("is_current").isEmpty()


def test_nothing_changed(run):
    assert outcome(run(BASE)) == (ID, (0, 0, 3, 0), 3, set())


def test_deletion(run):
    assert outcome(run(BASE[:2])) == (ID, (0, 0, 2, 1), 3, set())


COMPOSITE = ["401,crm,Mara,Lyon,Gold", "401,erp,Mara,Nice,Gold", "402,crm,Ivo,Porto,Silver"]
COMPOSITE_HEAD = "customer_id,source_system,name,city,tier"


def test_composite_key(run):
    source = ["401,crm,Mara,Lyon,Gold", "401,erp,Mara,Metz,Gold", COMPOSITE[2], "403,crm,Olga,Riga,Gold"]
    result = run(source, opened(*COMPOSITE), COMPOSITE_HEAD, key=["customer_id", "source_system"])
    assert outcome(result) == (["customer_id", "source_system"], (1, 1, 2, 0), 5, set())


def test_composite_key_inferred_as_one_column(run):
    # The last current row of 401 is the erp one; of its snapshot rows one agrees with it.
    source = ["401,crm,Mara,Lyon,Gold", "401,erp,Mara,Nice,Gold", COMPOSITE[2], "403,crm,Olga,Riga,Gold"]
    result = run(source, opened(*COMPOSITE), COMPOSITE_HEAD)
    assert outcome(result) == (ID, (1, 1, 2, 0), 5, DOUBLE)


def test_repeated_snapshot_key(run):
    target = opened("501,Mara,Lyon,Gold", "502,Ivo,Porto,Silver")
    source = ["501,Mara,Lyon,Gold", "502,Ivo,Porto,Silver", "501,Mara,Nantes,Gold"]
    result = run(source, target)
    assert outcome(result) == (ID, (0, 1, 2, 0), 3, DOUBLE)
    assert rows(result.output.filter("customer_id = 501"), "city", "is_current") == [
        ("Lyon", True), ("Nantes", True),
    ]
    with pytest.raises(ValueError, match="duplicate"):
        run(source, target, duplicates="error")


def test_repeated_key_and_a_deletion(run):
    result = run([BASE[0], "101,Mara,Nantes,Gold", BASE[1]])
    assert outcome(result) == (ID, (0, 1, 2, 1), 4, DOUBLE)


def test_null_key(run):
    target = opened("601,Mara,Lyon,Gold", "602,Ivo,Porto,Silver")
    result = run(["601,Mara,Lyon,Gold", ",Olga,Riga,Gold", "602,Ivo,Porto,Silver"], target)
    assert outcome(result) == (ID, (1, 0, 2, 0), 3, {"no_null_keys"})


def test_existing_history(run):
    target = [
        "701,Mara,Lyon,Silver,2026-01-01,2026-03-01,false", "701,Mara,Lyon,Gold,2026-03-01,,true",
        "702,Ivo,Porto,Silver,2026-02-01,,true",
    ]
    result = run(["701,Mara,Nice,Gold", "702,Ivo,Braga,Silver"], target)
    assert outcome(result) == (ID, (0, 2, 0, 0), 5, set())


def test_long_quoted_and_multi_line_text(run):
    long = "word " * 2000 + "end"
    target = opened(f'801,"{long}, x",Lyon,Gold', '802,"He said ""hi""\nthen left",Porto,Silver')
    result = run([f'801,"{long}, y",Lyon,Gold', '802,"He said ""hi""\nthen left",Porto,Silver'], target)
    assert outcome(result) == (ID, (0, 1, 1, 0), 3, set())
    assert "hi" in result.output.filter("customer_id = 802").first()["name"]


def test_unicode(run):
    target = opened("901,Jürgen,Köln,Gold", "902,João,São Paulo,Gold", "903,花子,東京,Gold")
    result = run(["901,Jürgen,Köln,Gold", "902,João,Brasília,Gold", "903,花子,東京,Gold"], target)
    assert outcome(result) == (ID, (0, 1, 2, 0), 4, set())


def test_spaces_do_not_matter_and_case_does(run):
    target = opened("1001,Mara,Lyon,Gold", "1002,Ivo,Porto,Silver")
    assert outcome(run(["1001,  Mara ,lyon,Gold", "1002,IVO, Porto,Silver"], target)) == (
        ID, (0, 2, 0, 0), 4, set(),
    )
    assert outcome(run(["1001,  Mara ,Lyon  ,Gold", "1002, Ivo,\tPorto,Silver"], target))[1] == (0, 0, 2, 0)


def test_unknown_snapshot_column_is_rejected(run):
    with pytest.raises(ValueError, match=r"^CSV validation errors: Source columns not found in target: \['country'\]$"):
        run(["101,Mara,FR,Gold"], head="customer_id,name,country,tier", target_head=HEAD,
            target=opened(BASE[0]))


def test_removed_snapshot_columns_leave_the_output(run):
    result = run(["101,Mara", "102,Ivo"], head="customer_id,name", target_head=HEAD)
    assert outcome(result) == (ID, (0, 0, 2, 1), 3, set())
    assert result.output.columns == ["customer_id", "name", "effective_from", "effective_to", "is_current"]


def test_output_and_audit_are_written(run, spark, tmp_path):
    paths = {"output_path": str(tmp_path / "out"), "audit_path": str(tmp_path / "audit")}
    result = run(BASE[:2], **paths)
    assert spark.read.parquet(paths["output_path"]).count() == 3
    logged = spark.read.parquet(paths["audit_path"]).first()
    assert (logged.source_name, logged.target_name, logged.deleted, logged.validation_passed) == (
        "source.csv", "target.csv", 1, True,
    )
    assert result.rows_inspected == 3 and result.seconds > 0 and result.overlaps_found == 0 and result.dropped_rows == 0


def test_kept_tables_go_with_the_result(run, spark, tmp_path):
    folder = tmp_path / "kept"
    with run(BASE[:2], folder=str(folder), explain=lambda p: "{}", provider="gemini") as result:
        assert list(folder.glob("sediment-*")) and result.explained.explanations.count() == 1
    assert not list(folder.glob("sediment-*"))


def test_audit_names_the_template_after_total_failure(run, spark, tmp_path):
    def fail(prompt):
        raise TimeoutError("no reply")

    for explain, provider in ((fail, "template"), (lambda p: "{}", "gemini")):
        path = str(tmp_path / provider)
        result = run(BASE[:2], explain=explain, provider="gemini", model="flash", audit_path=path)
        assert spark.read.parquet(path).first().provider == result.provider_used == provider
        assert result.explained.label == "gemini (flash)"


def test_row_counts_need_no_jobs_of_their_own(spark, snapshot, history, tmp_path):
    target = history((1, "a", "2026-01-01", None, True), (2, "b", "2026-01-01", None, None))
    source = snapshot((1, "z"))
    result = run_scd2(spark, source, target, DAY, ["id"], unique=True, output_path=str(tmp_path / "o"))
    assert (result.dropped_rows, result.rows_inspected) == (1, 2)
    again = run_scd2(spark, source, target, DAY, ["id"], unique=True)
    assert (again.dropped_rows, again.rows_inspected) == (1, 2)
    strict = run_scd2(spark, source, target.filter("is_current"), DAY, ["id"], unique=True, null_flags="error")
    assert (strict.dropped_rows, strict.rows_inspected) == (0, 2)


def test_schemas_and_single_lines_reach_the_reader(run, spark, tmp_path):
    schema = "customer_id string, name string, city string, tier string"
    meta = ", effective_from date, effective_to date, is_current boolean"
    result = run(
        ["007,Mara,Lyon,Gold"], target=opened("007,Mara,Lyon,Gold"), source_schema=schema,
        target_schema=schema + meta, multi_line=False, key=["customer_id"],
    )
    assert [r.customer_id for r in result.output.collect()] == ["007"]


def test_a_store_as_target_gets_the_difference(spark, snapshot, history, tmp_path):
    store = HistoryStore(spark, str(tmp_path / "store"), ["id"])
    store.start(history((1, "a", "2026-01-01", None, True)), datetime.date(2026, 6, 1))
    for name in ("wrong", "z"):
        result = run_scd2(spark, snapshot((1, name), (2, "n")), store, DAY, unique=True)
    assert result.rows_inspected == 3 and result.passed
    assert rows(store.read(), "id", "name", "is_current") == [(1, "a", False), (1, "z", True), (2, "n", True)]


def test_frames_instead_of_files(spark, snapshot, history):
    target = history((1, "a", "2026-01-01", None, True), (2, "b", "2026-01-01", None, None))
    result = run_scd2(spark, snapshot((1, "z")), target, DAY)
    assert summary(result.changes).first().changed == 1 and result.dropped_rows == 1


def test_headers_values_and_metadata_are_normalized(spark, tmp_path):
    path = write(
        tmp_path / "t.csv", " ID ,  Name,EFFECTIVE_FROM,Effective_To,Is_Current",
        ["1,  a  ,2026-01-01,2026-13-01,YES", "2,b,2026-01-02,2026-02-01,1", "3,c,x,,nope", "4,d,2026-01-03,,"],
    )
    df = load_snapshot(spark, path)
    assert df.columns == ["id", "name", "effective_from", "effective_to", "is_current"]
    assert rows(df, "id", "name", "is_current") == sorted(
        [(1, "a", True), (2, "b", True), (3, "c", False), (4, "d", None)], key=repr
    )
    days = {r.id: (r.effective_from, r.effective_to) for r in df.collect()}
    assert days[1] == (datetime.date(2026, 1, 1), None)
    assert days[2][1] == datetime.date(2026, 2, 1) and days[3] == (None, None)


def test_bad_inputs(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="empty or has no columns"):
        load_snapshot(spark, str(tmp_path / "empty.csv"))
    clash = write(tmp_path / "clash.csv", "Id,id ", ["1,2"])
    with pytest.raises(ValueError, match="equal after normalization"):
        load_snapshot(spark, clash)


def test_row_position_follows_the_file(spark, tmp_path):
    path = write(tmp_path / "o.csv", "id,name", [f"{i % 3},n{i}" for i in range(50)])
    df = load_snapshot(spark, path, keep_order=True)
    ordered = [r.name for r in df.orderBy("_row_order").collect()]
    assert ordered == [f"n{i}" for i in range(50)]


def test_parquet_snapshots(spark, tmp_path, snapshot):
    snapshot((1, " a ")).write.parquet(str(tmp_path / "p"))
    df = load_snapshot(spark, str(tmp_path / "p"), format="parquet", keep_order=True)
    assert df.first().name == "a" and "_row_order" in df.columns


def test_flags(spark):
    df = spark.sql("select explode(array('TRUE','1','Yes','no','0','',null,'y')) v")
    flags = [r[0] for r in df.select(ingest.parse_flag(df.v)).collect()]
    assert flags == [True, True, True, False, False, None, None, False]


def test_key_detection(frame):
    def detect(source_rows, ddl):
        df = frame(source_rows, ddl)
        return schema.detect_business_key(df, df)

    assert detect([(1, 1, "a")], "customer_id long, order_no long, name string") == ["customer_id", "order_no"]
    assert detect([(1, 1), (1, 2)], "customer_id long, order_no long") == ["order_no"]
    assert detect([(1, 1), (1, 2)], "id long, order_no long") == ["id"]
    assert detect([("x", "a"), ("x", "b")], "name string, city string") == ["city"]
    assert detect([("x", "a"), ("x", "a")], "name string, city string") == ["city"]
    assert detect([(1, "a"), (2, "a")], "paid long, name string") == ["paid"]
    assert detect([(None, 1), (1, 1)], "a_id long, b_id long") == ["a_id"]
    assert detect([(None, 1), (None, 1)], "a_id long, b_id long") == ["a_id", "b_id"]
    left, right = frame([(1,)], "a long"), frame([(1,)], "b long")
    with pytest.raises(ValueError, match="No shared columns"):
        schema.detect_business_key(left, right)


def test_key_scores_agree_with_detection(frame):
    df = frame([(1, 1, "a"), (2, 1, "b")], "id long, order_no long, name string")
    assert rows(schema.key_scores(df, df)) == [("id", 55), ("name", 10), ("order_no", 30)]


def test_compatibility_messages(frame, snapshot, history):
    assert schema.check_compatibility(snapshot((1, "a")), history()) == []
    assert schema.check_compatibility(history(), snapshot()) == [
        "Source CSV should not contain SCD2 metadata columns: ['effective_from', 'effective_to', 'is_current']",
        "Target CSV is missing required SCD2 columns: ['effective_from', 'effective_to', 'is_current']",
    ]
    nothing = snapshot().select()
    assert schema.check_compatibility(nothing, history()) == ["Source CSV has no columns."]
    wide = frame([(1, "a", "b")], "id long, name string, extra string")
    assert schema.check_compatibility(wide, history()) == ["Source columns not found in target: ['extra']"]


def test_unique_columns_with_and_without_a_sample_that_decides(spark, monkeypatch):
    df = spark.range(5000).selectExpr(
        "id", "id % 4000 as late", "id % 7 as small", "nullif(id, 3) as one_null", "nullif(id, id % 2) as nulls",
        "case when id < 4999 then id else 4998 end as last", "cast(null as string) as empty",
    )
    for size in (100, 4500, 10_000):
        monkeypatch.setattr(schema, "SAMPLE", size)
        assert schema.unique_columns(df, df.columns) == ["id", "one_null"]
    scores = {r[0]: r[1] for r in schema.key_scores(df, df).collect()}
    assert scores["id"] == 55 and scores["one_null"] == 10 and scores["late"] == 0
    assert schema.unique_columns(df.limit(0), ["id"]) == ["id"] and schema.unique_columns(df, []) == []
