"""From scan to validation, with the faults that must be refused, and the control documents on the way."""

import hashlib
import http.server
import json
import os
import threading
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from palimpsest import cli, views
from palimpsest.operators import mask, validate
from palimpsest.operators.mask import ColumnPlan, MaskError
from palimpsest.operators.seedmap import SeedMap, mask_with
from palimpsest.operators.validate import TableMeta
from palimpsest.plans import config, decide, history, llmclassify, runs
from palimpsest.sources import catalog as sources
from palimpsest.streaming.mask import mask_stream


@pytest.fixture(scope="module")
def people(spark, sf):
    return views.people(spark, sf).select("id", "full_name", "email", "phone", "dob_text", "status").cache()


@pytest.fixture(scope="module")
def folder(spark, people, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("source"))
    people.select("id", "email", "phone").write.parquet(f"{path}/contacts.parquet")
    spark.range(30).selectExpr("id", "CAST(id * 7 AS INT) AS quantity").write.parquet(f"{path}/facts.parquet")
    return path


META = {"contacts": TableMeta(keys=["id"]), "facts": TableMeta(keys=["id"])}


def test_plan_approve_mask_validate(spark, folder, tmp_path):
    source = sources.Catalog(spark, folder, META)
    settings = config.Config(source=folder, target=str(tmp_path / "out"), runs=str(tmp_path / "runs"))
    overrides = decide.Overrides({"not_sensitive": ["id", "quantity"]})
    report = decide.scan(source, overrides=overrides)
    assert {(d.column, d.sensitivity, d.rule) for d in report.found if d.table == "contacts"} == {("id", "not_sensitive", None), ("email", "sensitive", "email"), ("phone", "sensitive", "phone")}
    run = runs.Run.create(settings.runs, report, settings)
    with pytest.raises(runs.RunError):
        runs.apply(run, source, settings)  # not approved
    run.approve("reviewer")
    done = runs.apply(runs.Run.load(run.path), source, settings)
    assert done["contacts"].columns == ["email", "phone"] and done["facts"].columns == []
    target = sources.Catalog(spark, settings.target, META)
    issues = runs.validate_run(runs.Run.load(run.path), source, target, settings)
    assert runs.passed(issues, strict=True), [i for i in issues if i.status != "pass"]
    with pytest.raises(runs.RunError):
        runs.Run.load(run.path).approve("again")
    for same in (folder, f"file://{folder}/"):  # however it is spelled
        with pytest.raises(runs.RunError, match="same"):
            runs.apply(runs.Run.load(run.path), source, config.Config(source=folder, target=same))
    changed = json.load(open(run.path))
    changed["plan"]["decisions"][0]["sensitivity"] = "sensitive"
    with open(tmp_path / "changed.json", "w") as f:
        json.dump(changed, f)
    with pytest.raises(runs.RunError):
        runs.Run.load(str(tmp_path / "changed.json"))


@pytest.fixture
def approved(spark, folder, tmp_path):
    """A catalogue, settings, and a function that makes approved runs."""
    source = sources.Catalog(spark, folder, META)
    settings = config.Config(source=folder, target=str(tmp_path / "out"), runs=str(tmp_path / "runs"), seed_map=config.SeedMapSettings(path=str(tmp_path / "seeds")))

    def made():
        run = runs.Run.create(settings.runs, decide.scan(source, overrides=decide.Overrides({"not_sensitive": ["id", "quantity"]})), settings)
        run.approve("reviewer")
        return run

    return source, settings, made


def test_a_run_that_broke_off_is_resumed(spark, approved, monkeypatch):
    """Between a table's rename and the record's save, too: the copy says which attempt it is of."""
    source, settings, made = approved
    run = made()
    save, calls = runs.Run.save, []

    def broken(self):
        calls.append(self.data["execution"]["tables"].get("contacts", {}).get("status"))
        if calls[-1] == "applied":
            raise OSError("no space")
        save(self)

    monkeypatch.setattr(runs.Run, "save", broken)
    with pytest.raises(OSError):
        runs.apply(run, source, settings)
    monkeypatch.setattr(runs.Run, "save", save)
    assert os.path.exists(f"{settings.target}/contacts.parquet") and runs.Run.load(run.path).data["execution"]["status"] == "in_flight"
    before = spark.read.parquet(f"{settings.target}/contacts.parquet").orderBy("id").collect()
    with pytest.raises(runs.RunError, match="resume"):
        runs.apply(runs.Run.load(run.path), source, settings)
    done = runs.apply(runs.Run.load(run.path), source, settings, resume=True)
    assert done["contacts"].columns == ["email", "phone"] and done["facts"].rows == 30
    assert spark.read.parquet(f"{settings.target}/contacts.parquet").orderBy("id").collect() == before


def test_a_target_is_masked_again_only_for_a_reason(spark, approved):
    source, settings, made = approved
    runs.apply(made(), source, settings)
    before = spark.read.parquet(f"{settings.target}/contacts.parquet").orderBy("id").collect()
    again = made()
    for reason in (None, "  "):
        with pytest.raises(runs.RunError):
            runs.apply(again, source, settings, reason=reason)
    runs.apply(again, source, settings, reason="the first copy went astray")
    assert runs.Run.load(again.path).data["repeats"][0]["reason"] == "the first copy went astray"
    assert spark.read.parquet(f"{settings.target}/contacts.parquet").orderBy("id").collect() == before
    assert not [n for n in os.listdir(settings.target) if "__" in n]


def test_seed_map_of_a_run(spark, approved, folder):
    """Stored pairs come first and outlive the seed; a dry run stores none."""
    source, settings, made = approved
    pairs = runs.seed_map(spark, settings)
    plans = [ColumnPlan("email", "fake_email")]
    assert mask.dry_run(source.table("contacts"), plans, ["id"], "s", pairs=pairs).rows and pairs.count() == 0
    pairs.record(spark.createDataFrame([("source3@example.test", "kept@example.test")], "value string, masked_value string"), "fake_email", "fake_email")
    runs.apply(made(), source, settings)
    target = spark.read.parquet(f"{settings.target}/contacts.parquet")
    assert target.where("id = 3").first()["email"] == "kept@example.test"
    n = pairs.count()
    assert n == source.table("contacts").select("email").distinct().count() + source.table("contacts").where("phone IS NOT NULL").select("phone").distinct().count()
    mask.apply(source.table("contacts"), plans, ["id"], "another seed", f"{settings.target}/again", pairs=pairs)
    assert sorted(spark.read.parquet(f"{settings.target}/again").select("id", "email").collect()) == sorted(target.select("id", "email").collect())
    assert pairs.count() == n


def test_a_stored_pair_does_not_hide_faults(spark, people, tmp_path):
    """What a strategy can't replace, or what a pair would leave as it is, stops the table even if a pair is stored."""
    pairs = SeedMap(spark, str(tmp_path / "map"))
    pairs.record(people.select(F.col("status").alias("value"), F.lit("202-555-0100").alias("masked_value")), "fake_phone", "fake_phone")
    pairs.record(people.select(F.col("email").alias("value"), F.upper("email").alias("masked_value")), "fake_email", "fake_email")
    for column, strategy in (("status", "fake_phone"), ("email", "fake_email")):
        with pytest.raises(MaskError, match=column):
            mask.apply(people, [ColumnPlan(column, strategy)], ["id"], "s", str(tmp_path / column), pairs=pairs)
        assert not os.path.exists(tmp_path / column) and not os.path.exists(f"{tmp_path / column}__staging")


def test_drift_is_found(spark, approved, folder):
    source, settings, made = approved
    run = made()
    runs.apply(run, source, settings)
    target = sources.Catalog(spark, settings.target, META)
    other = sources.Catalog(spark, settings.target + "/elsewhere", META)
    with pytest.raises(runs.RunError):
        runs.validate_run(run, other, target, settings)  # not the source of the plan
    with pytest.raises(runs.RunError):
        runs.validate_run(run, source, source, settings)  # not its target
    assert [v["status"] for v in run.data["validations"]] == ["error", "error"]
    spark.range(3).write.parquet(f"{settings.target}/new.parquet")
    issues = runs.validate_run(run, source, target, settings)
    assert [i.message for i in issues if i.check == "scope"] == ["the target's tables aren't those of the plan: new"]


def test_coverage_and_explicit_columns(spark, folder, tmp_path):
    source = sources.Catalog(spark, folder, META)
    report = decide.scan(source)  # id and quantity stay undecided
    settings = lambda *columns: config.Config(validation=config.Validation(columns=list(columns)))
    found = {(i.table, i.column): i.status for i in runs.check(source, source, report.found, settings("main.contacts.email", "main.facts.quantity"), errors={"lost": "ValueError"}) if i.check == "coverage"}
    assert found == {("lost", ""): "error", ("contacts", "id"): "warning", ("contacts", "phone"): "warning", ("facts", "id"): "warning"}
    with pytest.raises(runs.RunError, match="nothing"):
        runs.check(source, source, report.found, settings("main.contacts.nothing"))
    with pytest.raises(ValueError):
        settings("email")


def test_undecided_columns_are_not_approved(spark, folder, tmp_path):
    report = decide.scan(sources.Catalog(spark, folder, META))
    run = runs.Run.create(str(tmp_path), report, config.Config())
    assert run.data["plan"]["target"] is None
    with pytest.raises(runs.RunError):
        run.approve("reviewer")


def test_one_writer(spark, tmp_path):
    with runs.lock(spark, str(tmp_path / "t")), pytest.raises(runs.RunError, match="locked by"), runs.lock(spark, f"file://{tmp_path}/t/"):
        pass
    assert not os.path.exists(tmp_path / "t.lock")


def test_faults_are_found_where_they_are(people):
    masked = mask.mask(people, [ColumnPlan("email", "fake_email")], "s")

    def status(target, **options):
        return {r["column_name"]: r["status"] for r in validate.completeness(people, target, ["id"], ["email"], **options).collect()}["email"]

    assert status(masked) == "pass"
    assert status(masked.withColumn("email", F.when(F.col("id") == 3, F.lit("source3@example.test")).otherwise(F.col("email")))) == "fail"
    assert status(masked.where("id <> 3")) == "fail"
    assert status(masked.withColumn("id", F.when(F.col("id") == 3, F.lit(-1)).otherwise(F.col("id")))) == "fail"
    assert status(masked, limit=10) == "warning"
    assert status(masked.where("id <> 3"), limit=10) == "warning"
    schema = {i.message: i.status for i in validate.schema_elements("people", people, masked.drop("phone"))}
    assert schema["columns"] == "fail" and schema["primary_key"] == "pass"
    assert [i.status for i in validate.row_counts({"p": people}, {"p": masked.limit(5)})] == ["fail"]
    assert [i.message for i in validate.presence({"a": people}, {"b": people})] == ["only in the source", "only in the target"]
    half = masked.withColumn("email", F.when(F.col("id").isin(4, 9, 14), F.concat(F.lit("source"), "id", F.lit("@example.test"))).otherwise(F.col("email")))
    rows = validate.failing_rows(people.where("id > 2"), half, ["id"], "email").collect()
    assert sorted(r["place"] for r in rows) == [2, 7, 12] and all(set(r["redacted"]) == {"*"} for r in rows)
    assert validate.failing_rows(people, people, ["id"], "email").count() == 5


def test_faults_between_tables_are_found(spark, sf, tmp_path):
    """Two tables masked for good agree on what they share; a changed address, a lost parent and a wrong total don't pass."""
    people, orders = views.people(spark, sf).select("id", "email"), views.people_orders(spark, sf)
    mask.apply(people, [ColumnPlan("email", "fake_email")], ["id"], "s", str(tmp_path / "people"))
    mask.apply(orders, [ColumnPlan("contact_email", "fake_email")], ["tenant_id", "order_id"], "s", str(tmp_path / "orders"))
    a, b = spark.read.parquet(str(tmp_path / "people")), spark.read.parquet(str(tmp_path / "orders"))
    apart = lambda x, y: validate.disagreeing(y, x, ("customer_id", "id"), ("contact_email", "email")).count()
    assert apart(a, b) == 0 and validate.orphans(b, a, "customer_id", "id").isEmpty()
    one = b.select("customer_id").first()[0]
    n = b.where(F.col("customer_id") == one).count()
    assert apart(a.withColumn("email", F.when(F.col("id") == one, "x@example.test").otherwise(F.col("email"))), b) == n
    assert validate.orphans(b, a.where(F.col("id") != one), "customer_id", "id").count() == n
    wrong = lambda df: df.where("total <> quantity * unit_price").count()
    assert wrong(b) == 0 and wrong(b.withColumn("total", F.when(F.col("customer_id") == one, F.col("total") + 1).otherwise(F.col("total")))) == n


def test_gate_refuses_without_values(people, tmp_path, spark):
    bad = [ColumnPlan("status", "fake_phone")]
    with pytest.raises(MaskError) as e:
        mask.dry_run(people, bad, ["id"], "s")
    assert "active" not in str(e.value) and "status" in str(e.value)
    assert mask.dry_run(people, [ColumnPlan("dob_text", "fake_date", null_markers=("N/A",))], [], "s").columns == ["dob_text"]
    for plans, keys in (([ColumnPlan("nothing", "redact")], []), ([ColumnPlan("email", "redact")], ["nothing"]), ([ColumnPlan("id", "redact")], [])):
        with pytest.raises(MaskError):
            mask.preflight(people, plans, keys)
    with pytest.raises(MaskError):
        mask.preflight(people, [ColumnPlan("email", "redact")], [], {"EMAIL": "generated"})
    with pytest.raises(MaskError):
        mask.apply(people, [ColumnPlan("email", "redact")], [], "s", str(tmp_path / "x"))
    assert mask.preflight(people, [ColumnPlan("email", "redact")], ["Email"])[1] == ["email"]
    assert mask.preflight(people, [ColumnPlan("EMAIL", "redact")], [])[0] == [ColumnPlan("email", "redact")]
    assert mask.mask(people, [ColumnPlan("Email", "blank")], "s").where("email <> ''").isEmpty()
    assert mask.gate(people, [ColumnPlan("Email", "blank")], "s").first()["unchanged"] == 0
    with pytest.raises(MaskError):
        mask.preflight(people, [ColumnPlan("email", "redact"), ColumnPlan("EMAIL", "blank")], [])
    shown = mask.dry_run(people, [ColumnPlan("email", "fake_email")], ["id"], "s").preview
    assert len(shown) == 10 and all(set(r["email"][0]) <= set("*@.") and "@" in r["email"][1] for r in shown)


def test_seed_map_outlives_seeds(spark, people, tmp_path):
    pairs = SeedMap(spark, str(tmp_path / "map"))
    first = mask_with(people, "email", "fake_email", "one", pairs).select("id", "email").collect()
    assert pairs.count() == people.select("email").distinct().count()
    again = SeedMap(spark, str(tmp_path / "map"))
    assert again.salt == pairs.salt
    assert sorted(mask_with(people, "email", "fake_email", "two", again).select("id", "email").collect()) == sorted(first)
    before = again.count()
    mask_with(people, "phone", "redact", "two", again)
    mask_with(people, "phone", "fake_phone", "two", again, write=False).collect()
    assert again.count() == before
    with open(tmp_path / "map" / "writer.lock", "w"), pytest.raises(Exception):  # noqa: B017  another writer
        mask_with(people, "phone", "fake_phone", "two", again)


def test_stream(spark, people, tmp_path):
    people.select("id", "email").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, email string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    mask_stream(stream, [ColumnPlan("email", "fake_email")], "s", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("id", "email")
    assert sorted(got.collect()) == sorted(mask.mask(people.select("id", "email"), [ColumnPlan("email", "fake_email")], "s").collect())


def test_catalog(spark, sf, tmp_path):
    c = sources.Catalog(spark, sf, {"customer": TableMeta(keys=["c_custkey"]), "lineitem": TableMeta(keys=["l_orderkey", "l_linenumber"])})
    assert "orders" in c.tables() and c.key_holds("customer") and not c.key_holds("lineitem") and c.keys("orders") == []
    assert c.column_type("customer", "c_custkey") == "bigint"
    spark.range(2).write.parquet(str(tmp_path / "db" / "sales" / "items.parquet"))
    spark.range(1).write.parquet(str(tmp_path / "db" / "top.parquet"))
    (tmp_path / "db" / "notes").mkdir()
    db = sources.Catalog(spark, str(tmp_path / "db"), describe=lambda t: TableMeta(keys=["id"]))
    assert db.schemas() == ["main", "sales"] and db.tables() == ["sales.items", "top"] and db.table("sales.items").count() == 2 and db.keys("top") == ["id"]
    assert sources.Catalog(spark, str(tmp_path / "db"), schemas=["sales"]).tables() == ["sales.items"]
    assert decide.Overrides({"sensitive": ["sales.items.id"]}).find("main", *sources.split("sales.items"), "id") == ("sensitive", None)
    first = c.page("customer", 10, columns=["c_custkey"]).collect()
    second = c.page("customer", 10, after=(first[-1][0],), columns=["c_custkey"]).collect()
    assert len(second) == 10 and second[0][0] > first[-1][0]
    with pytest.raises(KeyError):
        c.column_type("customer", "nothing")
    df = spark.createDataFrame([(1, None), (2, ""), (3, 'a "b", c\nd')], "id int, v string")
    sources.write_csv(df, str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in sources.read_csv(spark, str(tmp_path / "csv"), "id int, v string").collect())[2] == (3, 'a "b", c\nd')


def test_export_with_manifest(spark, tmp_path):
    before = spark.createDataFrame([(1, None, "a"), (2, r"\N", 'q"\nz'), (3, "", "c")], "id int, v string, w string")
    manifest = sources.export_pair(before, before.withColumn("v", F.lit("x")), ["id"], str(tmp_path / "pair"))
    lines = "".join(open(tmp_path / "pair" / "before" / n).read() for n in sorted(manifest["before"]["files"]))
    assert lines == '"1",\\N,"a"\n"2","\\N","q""\nz"\n"3","","c"\n'
    for side in ("before", "after"):
        for name, known in manifest[side]["files"].items():
            assert hashlib.sha256(open(tmp_path / "pair" / side / name, "rb").read()).hexdigest() == known["sha256"]
    for other in (before.where("id < 3"), before.unionByName(before.where("id = 1")), before.withColumn("id", F.col("id") + 1)):
        with pytest.raises(ValueError):
            sources.export_pair(before, other, ["id"], str(tmp_path / "no"))


def test_fingerprint_of_versions(people):
    rows = people.select("id", "email")
    mark = lambda df, n=None: mask.version_fingerprint(df, ["id"], n).first()
    assert mark(rows.repartition(7)) == mark(rows.coalesce(1)) and mark(rows)["rows"] == rows.count()
    swapped = rows.withColumn("id", F.when(F.col("id") == 3, 4).when(F.col("id") == 4, 3).otherwise(F.col("id")))
    assert mark(swapped) != mark(rows) and mark(swapped, 2) == mark(rows, 2)
    placed = mask.placed(rows.repartition(5), ["id"]).orderBy("id").collect()
    assert [r["place"] for r in placed] == list(range(1, len(placed) + 1))


def record(**changes):
    given = dict(database="main", schema="main", table="t", column="c", decision="mask", detected_type="email", masking_strategy="fake_email", review_status="approved", user_id="u", reviewed_by="r", reviewed_at="2024-01-01", analysis_date="2024-01-01", data_type="string", revision=1)
    return history.Record(**given | changes)


def test_history(spark, tmp_path):
    store = history.History(str(tmp_path / "h.json"))
    assert store.import_records([record()], preview=True)["inserted"] == 1 and not store.records
    store.import_records([record()])
    assert store.get("main", "main", "t", "c", "STRING").review_status == "approved"
    assert store.import_records([record()])["unchanged"] == 1
    with pytest.raises(ValueError):
        store.import_records([record(decision="keep", masking_strategy="")])  # not newer
    with pytest.raises(ValueError):
        store.import_records([record(decision="keep", masking_strategy="", revision=2)])  # approved
    assert store.import_records([record(decision="keep", masking_strategy="", revision=2)], overwrite_approved=True)["updated"] == 1
    demoted = history.History(str(tmp_path / "h.json")).get("main", "main", "t", "c", "bigint")
    assert demoted.review_status == "pending" and demoted.revision == 3 and "bigint" in demoted.reason
    with pytest.raises(ValueError):
        store.import_records([record(column="d"), record(column="d", decision="keep", masking_strategy="")])
    for bad in (record(reviewed_by=""), record(decision="maybe"), record(decision="keep"), record(revision=-1), record(user_id=" "), record(analysis_date=""), record(expires_at="soon"), record(decision="review"), record(review_status="odd")):
        with pytest.raises(ValueError):
            bad.validated()
    assert record(review_status="superseded").validated() == record(review_status="superseded")
    assert record(masking_strategy="").validated().review_status == "pending"
    assert record(masking_strategy="nothing").validated().review_status == "pending"
    assert history.same_type("decimal(12, 2)", "DECIMAL(12,2)") and history.same_type("integer", "int") and not history.same_type("int", "bigint")


def test_expiry_is_a_time():
    """20:00 five hours behind is 01:00 of the next day."""
    r = record(expires_at="2030-01-01T20:00:00-05:00")
    at = lambda text: r.applicable(now=history.moment(text)).review_status
    assert at("2030-01-01T23:00:00Z") == "approved" and at("2030-01-02T00:59:59+00:00") == "approved" and at("2030-01-02T01:00:00") == "pending"


def test_review_files(tmp_path):
    for name in ("x.csv", "x.md"):
        path = str(tmp_path / name)
        rows = [record(reason="a, b | c\nd"), record(column="e", reason="")]
        history.write_file(path, rows)
        assert history.read_file(path) == rows
        with pytest.raises(FileExistsError):
            history.write_file(path, [])
    header = history.NAMES[:13]
    (tmp_path / "short.csv").write_text("\ufeff" + ",".join(header) + ",\n" + ",".join(str(getattr(record(), n)) for n in header) + ",\n,,\n")
    assert history.read_file(str(tmp_path / "short.csv")) == [record(data_type="", revision=0)]
    for text in ("a,b\n", ",".join(history.NAMES[:12]) + "\n", ",".join([*header, "column"]) + "\n", ",".join(header) + "\nx\n", ",".join([*header, "revision"]) + "\n" + ",".join(["x"] * 14) + "\n"):
        (tmp_path / "bad.csv").write_text(text)
        with pytest.raises(ValueError):
            history.read_file(str(tmp_path / "bad.csv"))
    (tmp_path / "bad.md").write_text("| a |\n| b |\n")
    with pytest.raises(ValueError):
        history.read_file(str(tmp_path / "bad.md"))
    for name, odd in (("y.csv", "=1+1"), ("y.csv", " -x"), ("y.md", "a\\b"), ("y.md", " a"), ("y.md", "a<br>b"), ("y.txt", "")):
        with pytest.raises(ValueError):
            history.write_file(str(tmp_path / name), [record(reason=odd)])
        assert not os.path.exists(tmp_path / name)


@pytest.fixture
def reviewed(tmp_path):
    """A history of one approved record, and a sheet that adds a suggestion, to be edited."""
    path, sheet = str(tmp_path / "history.csv"), str(tmp_path / "review.csv")
    history.write_file(path, [record()])
    store = history.FileHistory(path)
    store.suggest(record(column="d", revision=0))
    history.export_review(store, sheet, store.for_review())
    return path, sheet


def edited(sheet, **changes):
    rows = [replace(r, **changes) if r.column == "d" else r for r in history.read_file(sheet)]
    history.write_file(sheet, rows, overwrite=True)


def test_write_back(reviewed, tmp_path):
    path, sheet = reviewed
    before = open(path).read()
    assert history.write_back(history.FileHistory(path), sheet, "me", apply=True)["skipped"] == 1 and open(path).read() == before
    edited(sheet, review_status="approved", reason="seen")
    done = history.write_back(history.FileHistory(path), sheet, "me")
    assert (done["dry_run"], done["inserted"], done["unchanged"], done["backup"]) == (True, 1, 1, None) and open(path).read() == before
    done = history.write_back(history.FileHistory(path), sheet, "me", apply=True)
    assert open(done["backup"]).read() == before and sorted(os.listdir(tmp_path)) == sorted(["history.csv", "review.csv", "review.csv.palimpsest.json", os.path.basename(done["backup"])])
    new = {r.column: r for r in history.read_file(path)}
    assert new["c"] == record() and (new["d"].reviewed_by, new["d"].revision, new["d"].reason) == ("me", 1, "seen")
    with pytest.raises(history.Conflict):  # the history has changed since
        history.write_back(history.FileHistory(path), sheet, "me", apply=True)


@pytest.mark.parametrize("changes", [{"data_type": "int"}, {"revision": 4}, {"user_id": "x"}, {"analysis_date": "2025-01-01"}, {"table": "other"}, {"masking_strategy": "nothing"}, {"decision": "keep"}])
def test_write_back_refuses(reviewed, changes):
    path, sheet = reviewed
    before = open(path).read()
    edited(sheet, **{"review_status": "approved"} | changes)
    with pytest.raises(ValueError):
        history.write_back(history.FileHistory(path), sheet, "me", apply=True)
    assert open(path).read() == before


def test_write_back_guards_its_files(reviewed, tmp_path):
    path, sheet = reviewed
    edited(sheet, review_status="approved")
    with pytest.raises(ValueError):
        history.write_back(history.FileHistory(path), sheet, " ")
    with pytest.raises(ValueError):
        history.write_back(history.FileHistory(path), path, "me")
    with pytest.raises(FileExistsError):
        history.export_review(history.FileHistory(path), sheet, [])
    with open(f"{path}.lock", "w"), pytest.raises(history.Conflict):
        history.write_back(history.FileHistory(path), sheet, "me", apply=True)
    os.unlink(f"{path}.lock")
    store = history.FileHistory(path)
    with open(path, "a") as f:
        f.write("\n")
    with pytest.raises(history.Conflict):
        history.write_back(store, sheet, "me", apply=True)
    os.unlink(history.companion(sheet))
    with pytest.raises(ValueError):
        history.write_back(history.FileHistory(path), sheet, "me")
    (tmp_path / "twice.csv").write_text(open(path).read().splitlines()[0] + "\n" + 2 * (open(path).read().splitlines()[1] + "\n"))
    with pytest.raises(history.Conflict):
        history.FileHistory(str(tmp_path / "twice.csv"))


def test_scan_order(spark, folder, tmp_path):
    store = history.History(str(tmp_path / "h.json"))
    store.import_records([record(table="contacts", column="phone", decision="keep", masking_strategy=""), record(table="contacts", column="email", review_status="pending", reviewed_by="", reviewed_at="")])
    c = sources.Catalog(spark, folder, META)
    found = {d.column: d for d in decide.scan(c, history=store, tables=["contacts"]).found}
    assert found["phone"].sensitivity == "not_sensitive" and found["email"].source == "history_pending"
    found = {d.column: d for d in decide.scan(c, config.Detection(skip_column_patterns=["^ph"]), decide.Overrides({"sensitive": [{"match": "pattern:e*", "rule": "blank"}]}), tables=["contacts"]).found}
    assert (found["phone"].source, found["email"].source, found["email"].rule) == ("skip", "override", "blank")
    assert decide.strategy_for(found["email"], config.Masking()) == "blank"
    assert decide.strategy_for(decide.Decision("t", "FirstName", "sensitive", "full_name"), config.Masking()) == "fake_first_name"
    assert decide.strategy_for(decide.Decision("t", "x", "sensitive", "url"), config.Masking()) == "format_random"
    assert decide.strategy_for(decide.Decision("t", "x", "sensitive", "url"), config.Masking(column_strategies={"T.X": "redact"})) == "redact"
    assert decide.strategy_for(decide.Decision("s.t", "x", "sensitive", "url"), config.Masking(column_strategies={"s.t.x": "redact"})) == "redact"
    made = decide.as_record("main", decide.Decision("s.t", "x", "sensitive", "email", data_type="string"), "u")
    assert (made.schema, made.table, made.masking_strategy) == ("s", "t", "fake_email") and made.validated() == made


class Fake:
    def __init__(self, *answers):
        self.answers, self.prompts = list(answers), []

    def ask(self, prompt):
        self.prompts.append(prompt)
        return self.answers.pop(0), 60


def test_language_model_fallback(spark, folder):
    fake = Fake('{"sensitive": true, "rule": "quantity", "confidence": 0.9}', '```json\n{"sensitive": false, "rule": null, "confidence": 0.5}\n```')
    asked = llmclassify.Classifier(fake, budget=100, send_values=False)
    found = {d.column: d for d in decide.scan(sources.Catalog(spark, folder, META), classifier=asked, tables=["facts"]).found}
    assert found["id"].source == "llm" and found["quantity"].sensitivity == "unknown" and "values" not in fake.prompts[0]
    with pytest.raises(llmclassify.BudgetSpent):
        asked.classify("t", "c", "string", [])
    # A bad answer, a failing provider or a spent budget leaves a column unknown, and the others are decided all the same.
    fake = Fake("no json")
    report = decide.scan(sources.Catalog(spark, folder, META), classifier=llmclassify.Classifier(fake, budget=1000), tables=["facts"])
    assert [d.sensitivity for d in report.found] == ["unknown"] * 2 and not report.errors and report.stats()["tokens"] == 60
    assert [d.detail.split(" ")[0] for d in report.found] == ["ResponseError", "RuntimeError"]
    report = decide.scan(sources.Catalog(spark, folder, META), classifier=llmclassify.Classifier(Fake('{"sensitive": false, "rule": null, "confidence": 1}'), budget=50), tables=["facts"])
    assert [d.sensitivity for d in report.found] == ["not_sensitive", "unknown"] and report.found[1].detail.startswith("BudgetSpent")


def test_http_provider(monkeypatch):
    """Both styles against a server of our own, reached through the configuration."""
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.headers.get("Authorization"), json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            answer = '{"sensitive": true, "rule": "email", "confidence": 1}'
            body = {"response": answer, "eval_count": 3} if "prompt" in asked[-1][1] else {"choices": [{"message": {"content": answer}}], "usage": {"total_tokens": 9}}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("KEY_OF_TEST", "k")
    options = {"url": f"http://127.0.0.1:{server.server_port}/", "model": "m"}
    for style, tokens in (("chat", 9), ("generate", 3)):
        made = llmclassify.from_settings(config.Llm(enabled=True, options={**options, "style": style, "key_variable": "KEY_OF_TEST"}))
        assert made.classify("t", "c", "string", ["v"]).rule == "email" and made.used == tokens and asked[-1][0] == "Bearer k"
    server.shutdown()
    assert llmclassify.from_settings(config.Llm()) is None
    with pytest.raises(ValueError):
        llmclassify.from_settings(config.Llm(enabled=True, provider="nothing"))


@pytest.mark.parametrize("answer", ["", "[]", '{"sensitive": true}', '{"sensitive": 1, "rule": "a", "confidence": 1}', '{"sensitive": true, "rule": "A b", "confidence": 1}', '{"sensitive": false, "rule": "a", "confidence": 1}', '{"sensitive": true, "rule": "a", "confidence": NaN}', '{"sensitive": true, "rule": "a", "rule": "b", "confidence": 1}', '{"sensitive": true, "rule": "a", "confidence": 2}'])
def test_answers_that_do_not_count(answer):
    with pytest.raises(llmclassify.ResponseError):
        llmclassify.parse(answer)


def test_config_and_cli(spark, folder, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("SOURCE", folder)
    path = tmp_path / "palimpsest.yaml"
    path.write_text("source: ${SOURCE}\ntarget: ${TARGET:" + str(tmp_path / "out") + "}\nkeys: {contacts: [id], facts: [id]}\nruns: runs\nmasking: {seed: s}\nhistory: " + str(tmp_path / "h.json") + "\n")
    c = config.load(str(path))
    assert c.source == folder and c.runs == str(tmp_path / "runs")
    run = lambda *a: cli.main(["--config", str(path), *a], spark)
    assert run("scan") == 0 and "contacts email sensitive email pattern" in capsys.readouterr().out
    assert run("mask") == 0 and "would be masked: email" in capsys.readouterr().out and not os.path.exists(c.target)
    assert run("mask", "--apply") == 2
    assert run("strategies") == 0 and "fake_email" in capsys.readouterr().out
    assert run("history") == 0
    path.write_text(path.read_text().replace("h.json", "h.csv").replace("masking:", "seed_map: {path: " + str(tmp_path / "seeds") + "}\nmasking:"))
    decided = [record(table=t, column=k, decision="keep", masking_strategy="", detected_type="", data_type=d) for t, k, d in (("contacts", "id", "bigint"), ("facts", "id", "bigint"), ("facts", "quantity", "int"))]
    history.write_file(str(tmp_path / "h.csv"), decided[:2])
    assert run("scan", "--output", str(tmp_path / "review.csv"), "--run-file", str(tmp_path / "runs" / "draft.json")) == 0
    sheet = history.read_file(str(tmp_path / "review.csv"))
    assert {(r.table, r.column): r.decision for r in sheet}["facts", "quantity"] == "review"
    history.write_file(str(tmp_path / "review.csv"), [replace(r, review_status="approved", decision="keep") if r.column == "quantity" else r for r in sheet], overwrite=True)
    assert run("history-writeback", str(tmp_path / "review.csv"), "--reviewed-by", "me", "--apply") == 0
    capsys.readouterr()
    assert run("plan") == 0
    plan = capsys.readouterr().out.strip()
    assert run("approve", plan, "--reviewer", "me") == 0
    assert run("mask") == 0
    shown = capsys.readouterr().out
    assert "'email': '" in shown and "source" not in shown and "*" in shown and "after:" in shown
    assert run("mask", "--show-values") == 0 and "source" in capsys.readouterr().out
    assert run("mask", "--resume") == 2 and run("mask", "--apply", "--run-file", plan, "--resume", "--remask-reason", "x") == 2
    assert run("mask", "--apply", "--resumable", "--run-file", plan) == 0 and run("seeds") == 0 and "fake_email" in capsys.readouterr().out
    with pytest.raises(runs.RunError):
        run("mask", "--apply", "--run-file", plan)
    assert run("mask", "--apply", "--run-file", plan, "--remask-reason", "test") == 0
    assert run("validate", "--strict", "--run-file", plan) == 0 and run("validate", "--strict") == 0
    (tmp_path / "src").mkdir()
    os.symlink(f"{folder}/contacts.parquet", tmp_path / "src" / "contacts.parquet")
    (tmp_path / "src" / "broken.parquet").write_text("x")
    path.write_text(path.read_text().replace("${SOURCE}", str(tmp_path / "src")))
    assert run("scan") == 3 and run("mask") == 2
    assert run("validate", "--json") == 1 and any(i["status"] == "error" and i["table"] == "broken" for i in json.loads(capsys.readouterr().out.splitlines()[-1]))
    path.write_text("source: x\nmasking: {wrong: 1}\n")
    with pytest.raises(ValueError):
        config.load(str(path))
    path.write_text("source: ${NOT_SET_ANYWHERE}\n")
    with pytest.raises(ValueError):
        config.load(str(path))
