import re
import pytest
from pyspark.sql import functions as F

from lectern.operators import sync
from lectern.plans import corpus
from lectern.sources import sinks

LISTING = "id string, name string, drive_path string, mimeType string, modifiedTime string, md5Checksum string"
MANIFEST = "drive_file_id string, name string, drive_path string, mime_type string, modified_time string, md5_checksum string, chunks_count int, status string"


def listed(spark, *rows):
    return spark.createDataFrame([(i, n, p, None, m, c) for i, n, p, m, c in rows], LISTING)


def known(spark, *rows):
    return spark.createDataFrame([(i, n, p, None, m, c, 3, s) for i, n, p, m, c, s in rows], MANIFEST)


def classes(plan):
    return {r.file_id: r["class"] for r in plan.collect()}


def test_plan(spark):
    listing = listed(
        spark, ("new", "novo.pdf", None, "2026-08-25T10:00:00Z", None), ("same", "igual.pdf", None, "2026-08-25T10:00:00Z", "abc"),
        ("changed", "alterado.pdf", None, "2026-08-25T11:00:00Z", "new-hash"), ("retry", "retry.pdf", None, "2026-08-25T10:00:00Z", None),
        ("renamed", "nome-novo.pdf", "ROOT/nome-novo.pdf", "2026-08-25T10:00:00Z", "same"), ("time", "t.pdf", "", "2026-08-25T10:00:00Z", ""),
        ("odd", "o.pdf", None, "ontem", None), ("odd2", "o2.pdf", None, "ontem", None))
    manifest = known(
        spark, ("same", "igual.pdf", None, "1999-01-01T00:00:00Z", "abc", "active"),
        ("changed", "alterado.pdf", None, "2026-08-25T10:00:00+00:00", "old-hash", "active"),
        ("removed", "removido.pdf", None, "2026-08-24T10:00:00+00:00", None, "active"),
        ("retry", "retry.pdf", None, "2026-08-25T10:00:00+00:00", None, "error"),
        ("renamed", "nome-antigo.pdf", "ROOT/nome-antigo.pdf", "2026-08-25T10:00:00+00:00", "same", "active"),
        ("time", "t.pdf", None, "2026-08-25T07:00:00-03:00", "x", "active"), ("odd", "o.pdf", None, "ontem", None, "active"),
        ("odd2", "o2.pdf", None, "hoje", None, "active"))
    assert classes(sync.plan_sync(listing, manifest)) == {
        "new": "new", "same": "unchanged", "changed": "changed", "removed": "removed", "retry": "changed", "renamed": "changed",
        "time": "unchanged", "odd": "unchanged", "odd2": "changed"}


def test_repeated_ids_last_wins(spark):
    listing = listed(spark, ("a", "x.pdf", None, "2026-01-01T00:00:00Z", None)).withColumn("seen", F.lit(1)).unionByName(
        listed(spark, ("a", "y.pdf", None, "2026-01-01T00:00:00Z", None)).withColumn("seen", F.lit(2)))
    manifest = known(spark, ("a", "y.pdf", None, "2026-01-01T00:00:00Z", None, "active")).withColumn("seen", F.lit(1))
    assert classes(sync.plan_sync(listing, manifest, "seen")) == {"a": "unchanged"}


def test_repeated_ids_without_a_column_to_order_by(spark):
    listing = listed(spark, ("a", "x.pdf", None, "2026-01-01T00:00:00Z", None), ("a", "x.pdf", None, "2026-01-03T00:00:00Z", None))
    manifest = known(spark, ("a", "x.pdf", None, "2026-01-03T00:00:00Z", None, "active"), ("a", "x.pdf", None, "2026-01-01T00:00:00Z", None, "active"))
    assert [(r.file_id, r["class"]) for r in sync.plan_sync(listing, manifest).collect()] == [("a", "unchanged")]
    new = spark.createDataFrame([("1", "x"), ("1", "x"), ("2", "y")], "id string, content string")
    assert sorted(r.id for r in sync.upsert_chunks(new.limit(0), new).collect()) == ["1", "2"]


def test_batch_takes_changed_first(spark):
    listing = listed(
        spark, ("new-a", "novo-a.pdf", None, "2026-08-25T10:00:00Z", None), ("new-b", "novo-b.pdf", None, "2026-08-25T10:00:00Z", None),
        ("changed", "alterado.pdf", None, "2026-08-25T11:00:00Z", None))
    manifest = known(spark, ("changed", "alterado.pdf", None, "2026-08-25T10:00:00+00:00", None, "active"))
    got = {r.file_id: r.selected for r in sync.select_batch(sync.plan_sync(listing, manifest), 2).collect()}
    assert got == {"changed": True, "new-a": True, "new-b": False}
    with pytest.raises(ValueError):
        sync.select_batch(sync.plan_sync(listing, manifest), 0)


def test_jobs(spark):
    listing = listed(
        spark, ("new", "novo.pdf", None, "2026-08-25T10:00:00Z", None), ("changed", "alterado.pdf", None, "2026-08-25T11:00:00Z", None),
        ("twin", "novo.pdf", None, "2026-08-25T10:00:00Z", None))
    manifest = known(
        spark, ("changed", "alterado.pdf", None, "2026-08-25T10:00:00Z", None, "active"),
        ("removed", "removido.pdf", None, "2026-08-25T10:00:00Z", None, "active"))
    jobs = sync.jobs_from_plan(sync.plan_sync(listing, manifest), listing).orderBy("priority", "drive_file_id").collect()
    assert [(j.action, j.drive_file_id, j.cleanup_legacy_source) for j in jobs] == [
        ("changed", "changed", True), ("new", "new", False), ("new", "twin", False), ("removed", "removed", None)]
    assert jobs[-1].drive_path == "removido.pdf" and jobs[-1].mime_type == "application/octet-stream"


def fake_embed(texts, task):
    return [[float(len(t)), 1.0] for t in texts]


def reconcile(spark, listing, manifest, contents, target):
    files = spark.createDataFrame(contents, "id string, content binary")
    return corpus.reconcile(listing, manifest, files, target, lambda b: b.decode().split("\f"), fake_embed, 2)


def test_reconcile_is_idempotent_and_leaves_no_stale_rows(spark, tmp_path):
    listing = listed(spark, ("a", "a.pdf", "ROOT/a.pdf", "2026-01-02T00:00:00Z", None), ("b", "b.pdf", "ROOT/b.pdf", "2026-01-02T00:00:00Z", None))
    manifest = known(spark, ("a", "a.pdf", "ROOT/a.pdf", "2026-01-01T00:00:00Z", None, "active"), ("gone", "g.pdf", None, "2026-01-01T00:00:00Z", None, "active"))
    contents = [("a", b"Silva (2020). Um titulo bem comprido\ftexto novo"), ("b", b"outro\f \ftexto")]
    empty, *_ = reconcile(spark, listing, manifest, [("zz", b"")], spark.createDataFrame([], "id string, drive_file_id string, source string"))
    old = spark.createDataFrame(
        [("old-a", "velho", "a.pdf", "a"), ("legacy", "sem id", "a.pdf", None), ("other", "fica", "o.pdf", "o"), ("g1", "x", "g.pdf", "gone"), ("free", "fica", "z.pdf", None)],
        "id string, content string, source string, drive_file_id string")
    target = empty.limit(0).unionByName(old, allowMissingColumns=True)
    first, new_manifest, results, report, _ = reconcile(spark, listing, manifest, contents, target)
    stored = sinks.DealtTable(spark, str(tmp_path / "table"), parts=4)
    stored.replace(first, list(range(4)))
    table = stored.read()
    rows = {(r.drive_file_id, r.page_number, r.chunk_index, r.content): r for r in table.collect()}
    assert set(rows) == {
        ("a", 1, 0, "Silva (2020). Um titulo bem comprido"), ("a", 2, 1, "texto novo"), ("b", 1, 0, "outro"), ("b", 3, 1, "texto"),
        ("o", None, None, "fica"), (None, None, None, "fica")}
    assert rows[("a", 2, 1, "texto novo")].reference_title == "Um titulo bem comprido"
    assert {(r.id, r.action, r.status, r.total_chunks, r.removed) for r in results.collect()} == {
        ("a", "changed", "active", 2, 1), ("b", "new", "active", 2, 0), ("gone", "removed", "removed", 0, 1)}
    assert {(r.drive_file_id, r.status, r.chunks_count) for r in new_manifest.collect()} == {("a", "active", 2), ("b", "active", 2)}
    assert {(r.action, r.ok, r.inserted, r.removed) for r in report.collect()} == {("changed", 1, 2, 1), ("new", 1, 2, 0), ("removed", 1, 0, 1)}
    # with the new manifest there is nothing left to do
    assert {r["class"] for r in reconcile(spark, listing, new_manifest, contents, table).plan.collect()} == {"unchanged"}
    again, *_ = reconcile(spark, listing, manifest, contents, table)
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in table.collect())
    stored.replace(again, list(range(4)))
    assert stored.read().count() == 6


def test_failed_files_keep_their_chunks(spark, tmp_path):
    """A broken file and one without bytes stay as they were, an empty one loses its chunks; chunks are embedded once."""
    times = "2026-01-02T00:00:00Z", "2026-01-01T00:00:00Z"
    names = ["good", "broken", "lost", "blank"]
    listing = listed(spark, *((n, f"{n}.pdf", None, times[0], None) for n in names))
    manifest = known(spark, *((n, f"{n}.pdf", None, times[1], None, "active") for n in names))
    target = spark.createDataFrame(
        [(f"old-{n}", "velho", f"{n}.pdf", n) for n in names] + [(f"free-{n}", "sem id", f"{n}.pdf", None) for n in names],
        "id string, content string, source string, drive_file_id string")
    calls = str(tmp_path)

    def extract(data):
        if data == b"broken":
            raise ValueError("unreadable")
        return data.decode().split("\f")

    def embed(texts, task):
        import uuid
        with open(f"{calls}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(texts)))
        return [[1.0, 2.0] for _ in texts]

    contents = spark.createDataFrame([("good", b"um\fdois"), ("good", b"um\fdois"), ("broken", b"broken"), ("blank", b" \f ")], "id string, content binary")
    table, entries, results, _, _ = corpus.reconcile(listing, manifest, contents, target, extract, embed, 2)
    rows = {r.id: r.content for r in table.collect()}
    assert {k for k in rows if k.startswith(("old", "free"))} == {"old-broken", "old-lost", "free-broken", "free-lost"}
    assert sorted(v for k, v in rows.items() if not k.startswith(("old", "free"))) == ["dois", "um"]
    state = {r.id: (r.success, r.status, r.errors) for r in results.collect()}
    assert state["good"] == (True, "active", []) and state["blank"][:2] == (True, "unsupported")
    assert state["broken"] == (False, "error", ["ValueError: unreadable"]) and state["lost"][:2] == (False, "error")
    assert {r.drive_file_id: r.status for r in entries.collect()} == {"good": "active", "blank": "active", "broken": "error", "lost": "error"}
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == 2
    # the failed ones are tried again, the others rest
    plan = sync.plan_sync(listing, entries.drop("modified_time").withColumn("modified_time", F.lit(times[0])))
    assert classes(plan) == {"good": "unchanged", "blank": "unchanged", "broken": "changed", "lost": "changed"}


def files_of(path):
    return {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet") if "_columns" not in str(f)}


CHUNK = "id string, content string, drive_file_id string, source string"


def test_an_upsert_touches_its_parts_only(spark, tmp_path):
    rows = [(f"{n}-{i}", "old", f"f{n}", f"{n}.pdf") for n in range(40) for i in range(3)] + [("free", "old", None, "3.pdf")]
    path = str(tmp_path / "t")
    sinks.write_chunks(spark.createDataFrame(rows, CHUNK), path, parts=16)
    before = files_of(tmp_path / "t")
    new = spark.createDataFrame([("3-0", "new", "f3", "3.pdf"), ("3-9", "new", "f3", "3.pdf"), ("99-0", "new", "f99", "99.pdf")], CHUNK)
    for _ in range(2):  # repeating a write changes nothing
        got = sinks.write_chunks(new, path, parts=16, touched=new.select("drive_file_id"))
        want = {r[0]: r[1] for r in rows if r[2] != "f3"} | {"3-0": "new", "3-9": "new", "99-0": "new"}
        assert {r.id: r.content for r in got.collect()} == want and got.count() == len(want)
    after = files_of(tmp_path / "t")
    kept = {f for f in before if after.get(f) == before[f]}
    assert len({f.parent for f in before}) - len({f.parent for f in kept}) <= 2 < len(kept)
    # only the folders of touched parts are read
    table = sinks.DealtTable(spark, path, parts=16)
    plan = table.read(table.touched(new))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part_of_16", plan)
    with pytest.raises(ValueError):
        sinks.DealtTable(spark, path, parts=8).read()
    with pytest.raises(ValueError):  # a column that the table does not have
        sinks.write_chunks(new.withColumn("more", F.lit(1)), path, parts=16)


def test_a_part_that_loses_all_rows_is_empty(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", "x", "f1", "s"), ("b", "x", "f2", "s")], CHUNK)
    sinks.write_chunks(rows, path, parts=64)
    gone = spark.createDataFrame([("f1",), ("unknown",)], "drive_file_id string")
    assert [r.id for r in sinks.write_chunks(rows.limit(0), path, parts=64, touched=gone).collect()] == ["b"]
    assert sinks.write_chunks(rows.limit(0), path, parts=64, touched=rows.select("drive_file_id")).count() == 0
    assert sinks.write_chunks(rows, path, parts=64).count() == 2
    empty = str(tmp_path / "empty")
    assert sinks.write_chunks(rows.limit(0), empty).count() == 0 and sinks.write_chunks(rows, empty).count() == 2


def test_a_failed_change_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", "x", "f1", "s"), ("b", "x", "f2", "s")], CHUNK)
    sinks.write_chunks(rows, path)
    before = files_of(tmp_path / "t")
    broken = rows.withColumn("content", F.when(F.col("id") == "b", F.raise_error(F.lit("boom"))).otherwise(F.col("content")))
    with pytest.raises(Exception):
        sinks.write_chunks(broken, path)
    assert files_of(tmp_path / "t") == before


def test_repeated_ids_without_an_order_are_settled_by_all_columns(spark):
    target = spark.createDataFrame([("a", 1, "t"), ("z", 1, "t")], "id string, n int, content string")
    new = [("a", 2, "x"), ("a", 3, "b"), ("a", 3, "c"), ("b", 1, "only"), ("c", None, "n"), ("c", 0, None)]
    for rows in (new, new[::-1]):
        got = sync.upsert_chunks(target, spark.createDataFrame(rows, target.schema)).collect()
        assert sorted(map(tuple, got)) == [("a", 3, "c"), ("b", 1, "only"), ("c", 0, None), ("z", 1, "t")]
    by = sync.upsert_chunks(target, spark.createDataFrame(new, target.schema), [-F.col("n")]).filter("id = 'a'").collect()
    assert [tuple(r) for r in by] == [("a", 2, "x")]


def test_only_bytes_of_chosen_files_are_read_and_none_are_moved(spark, tmp_path):
    contents = sinks.DealtTable(spark, str(tmp_path / "contents"), ("id",), parts=32)
    contents.replace(spark.createDataFrame([(f"f{i}", f"text {i}".encode()) for i in range(200)] + [("f7", b"another")], "id string, content binary"), list(range(32)))
    chosen = spark.createDataFrame([("f7", "n"), ("f8", "n"), ("none", "n")], "file_id string, name string")
    found = corpus.chosen_contents(chosen, contents)
    got = {r.file_id: r.content for r in found.collect()}
    assert got["f8"] == b"text 8" and got["none"] is None and got["f7"] in (b"text 7", b"another") and found.count() == 3
    single = corpus.chosen_contents(chosen.filter("file_id <> 'f7'"), contents)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in single.splitlines() if "FileScan" in x and "content#" in x]
    assert scans and all("part_of_32" in x.split("PartitionFilters")[1] for x in scans)
    assert not re.search(r"Exchange (hash|range|single)[^\n]*\n[^E]*content", single)
    for line in single.splitlines():
        assert not ("Exchange hashpartitioning" in line and "content" in line)


def test_manifest_rows(spark):
    results = spark.createDataFrame(
        [("a", "a.pdf", None, None, "", None, 4, True, "active", []), ("b", "b.pdf", "R/b", "m", "2026-01-01T00:00:00Z", "s", 0, True, "unsupported", ["e1", "e2"]),
         ("c", "c.pdf", "R/c", "m", None, None, 0, False, "active", ["x" * 5000])],
        "id string, name string, drive_path string, mime_type string, modified_time string, md5_checksum string, total_chunks int, success boolean, status string, errors array<string>")
    now = F.to_timestamp(F.lit("2026-02-02 00:00:00"))
    a, b, c = sync.manifest_rows(results, now).orderBy("drive_file_id").collect()
    assert (a.drive_path, a.mime_type, a.status, a.last_error, a.modified_time.year, a.modified_time.month) == ("a.pdf", "application/octet-stream", "active", None, 2026, 2)
    assert (b.status, b.last_error, b.last_synced_at is None) == ("active", "e1; e2", False)
    assert (c.status, len(c.last_error), c.last_synced_at) == ("error", 4000, None)
