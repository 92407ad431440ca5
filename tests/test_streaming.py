import pathlib

from pyspark.sql import functions as F

from umbra.operators import rewrite
from umbra.sources import outputs
from umbra.streaming.anonymize import anonymized_stream, compact, entities_at


def test_stream_carries_the_table(spark, tmp_path):
    rows = [(1, "a@b.org and 10.0.0.1"), (2, "none"), (3, "a@b.org again"), (4, None)]
    schema = "id int, text string"
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        anonymized_stream(stream, ["id"], bytes(16), f"{tmp_path}/out", f"{tmp_path}/map", f"{tmp_path}/state", once=True).awaitTermination()
    table = entities_at(spark, f"{tmp_path}/map")
    assert {(r.original, r.type) for r in table.collect()} == {("a@b.org", "EMAIL_ADDRESS"), ("10.0.0.1", "IP_ADDRESS")}
    out = spark.read.parquet(f"{tmp_path}/out").selectExpr("id", "anonymized AS text")
    assert "@" not in str(out.collect())
    back = dict(rewrite.restored(out, table, ["id"]).select("id", "restored").collect())
    assert back == dict(rows)


SCHEMA = "id int, text string"


def streamed(spark, parts, path, compacting=False, **more):
    """The table and the texts after each part came as a batch of its own."""
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{path}/in")
        anonymized_stream(stream, ["id"], bytes(16), f"{path}/out", f"{path}/map", f"{path}/state", once=True, **more).awaitTermination()
        if compacting:
            compact(spark, f"{path}/map")
    table = {(r.token, r.original, r.type, r.occurrences, r.source, r.collision) for r in entities_at(spark, f"{path}/map").collect()}
    texts = {r.id: r.anonymized for r in spark.read.parquet(f"{path}/out").collect()}
    return table, texts


def test_batches_with_collisions_are_as_one(spark, tmp_path):
    rows = [(k, f"u{k % 7}@a.org and v{k}@b.org, 10.0.0.{k % 3}") for k in range(24)] + [(24, None), (25, "none")]
    few = lambda kind, original: F.concat(F.lit("⟦"), F.when(kind == "IP_ADDRESS", "A").otherwise("E"), F.lit("-AAAA"), F.substring(F.lit("ABC"), (F.length(original) % 3 + 1).cast("int"), F.lit(1)), F.lit("⟧"))
    one = streamed(spark, [rows], tmp_path / "one", base_of=few)
    two = streamed(spark, [rows[:9], rows[9:]], tmp_path / "two", base_of=few)
    three = streamed(spark, [rows[:9], rows[9:15], rows[15:]], tmp_path / "three", compacting=True, base_of=few)
    assert one == two == three
    assert sum(r[5] for r in one[0]) > 20 and len({r[0] for r in one[0]}) == len(one[0])


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    many = [(k, f"someone{k}@place{k}.org") for k in range(3000)]
    table, texts = streamed(spark, [many, [(9000, "someone1@place1.org and new@x.org")]], tmp_path)
    assert len(table) == 3001 and {r[3] for r in table if r[1] == "someone1@place1.org"} == {2} and "@" not in str(texts)
    size = lambda n: sum(f.stat().st_size for f in pathlib.Path(f"{tmp_path}/map/batch={n}").rglob("*.parquet"))
    assert spark.read.parquet(f"{tmp_path}/map/batch=1").count() == 2 and size(1) < size(0) / 10


def test_outputs_are_written_and_listed(spark, tmp_path):
    docs = spark.createDataFrame([("a.txt", "one\ntwo\n"), ("b c.md", ""), ("d=e.txt", None)], "name string, text string")
    maps = spark.createDataFrame([("a.txt", "{}")], "name string, json string")
    reports = spark.createDataFrame([("a.txt", "# r"), ("b c.md", "# s")], "name string, report string")
    rows = outputs.outputs(docs, maps, reports)
    outputs.write(rows, f"{tmp_path}/o", 4)
    back = outputs.read(spark, f"{tmp_path}/o")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, rows.collect())) and back.count() == 6
    assert {r.document: r.names for r in outputs.archive_listing(back).collect()} == {"a.txt": ["a.anonymise.txt", "a.json"], "b c.md": ["b c.anonymise.md"], "d=e.txt": ["d=e.anonymise.txt"]}
    outputs.export(rows.filter("content IS NOT NULL"), f"{tmp_path}/x")
    assert {tuple(r) for r in outputs.exported(spark, f"{tmp_path}/x").collect()} == {(r.document, r.name, r.content) for r in rows.filter("content IS NOT NULL").collect()}
