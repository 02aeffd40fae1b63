import random

from gazeloom.sources import archive

SCHEMA = "file_id bigint, path string, content string, block string, length int"
LINE = "1.0,2.0,{t},1,400,{r},{f},0,0,10,10,0"


def files(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_round_trip(spark):
    rows = [(i, f"d{i % 7}/é{i}.csv", f"añb\r\n{i}," * (i % 9)) for i in range(60)] + [(60, "big", "x" * 5000), (61, "none", None), (62, "big", "y" * 3000), (None, None, "lost?")]
    packed = archive.pack_containers(files(spark, rows + rows[:3]), "file_id", "path", "content", 1000).cache()
    got = {(r.ident, r.path): r for r in archive.unpack_containers(packed).collect()}
    assert {k: r.content.decode() for k, r in got.items()} == {(i, p): c or "" for i, p, c in rows} and all(r.intact for r in got.values())
    sizes = {r.container_id: (r.n_files, r.n_bytes, len(r.block)) for r in packed.collect()}
    assert all(n == b for _, n, b in sizes.values()) and len(sizes) < 12 and sum(f for f, _, _ in sizes.values()) == len(rows)
    assert max(n for f, n, _ in sizes.values() if f > 1) < 2000


def test_different_content_of_one_name_is_kept(spark):
    rows = [(1, "a", "abc"), (1, "a", "xy"), (1, "a", "xy"), (None, None, "p"), (None, None, "q")]
    packed = archive.pack_containers(files(spark, rows), "file_id", "path", "content")
    got = archive.unpack_containers(packed).collect()
    assert sorted(r.content for r in got) == [b"abc", b"p", b"q", b"xy"] and all(r.intact for r in got)


def test_bytes_are_original_and_found_by_path(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, f"d/{i % 20}", rng.randbytes(rng.randrange(300))) for i in range(50)] + [(50, "d/all", bytes(range(256))), (51, "d/bad", b"\xff\xfe\x80"), (52, "d/big", rng.randbytes(2500))]
    df = spark.createDataFrame(rows, "n int, p string, b binary").repartition(7)
    archive.write_containers(archive.pack_containers(df, "n", "p", "b", 1000), str(tmp_path))
    back = archive.unpack_containers(archive.read_containers(spark, str(tmp_path))).collect()
    assert {(r.ident, r.path, bytes(r.content), r.intact) for r in back} == {(*r, True) for r in rows}
    total, blocks = sum(len(r[2]) for r in rows[:-1]), list(tmp_path.glob("blocks/*.parquet"))
    assert len(blocks) <= total // 1000 + 2  # a file per container
    found = archive.find_files(spark, str(tmp_path), ["d/bad", "d/3", "not there"])
    assert {(r.ident, bytes(r.content)) for r in found.collect()} == {(r[0], r[2]) for r in rows if r[1] in ("d/bad", "d/3")}
    assert len(found.inputFiles()) <= 4 and archive.find_files(spark, str(tmp_path), ["no"]).count() == 0


def test_containers_are_full_at_any_number_of_partitions(spark):
    df = files(spark, [(i, f"p{i}", "x" * 100) for i in range(300)])
    for n in (1, 50):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            assert archive.pack_containers(df, "file_id", "path", "content", 1000).count() == 30
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_damage_is_seen(spark):
    packed = archive.pack_containers(files(spark, [(1, "a", "abc")]), "file_id", "path", "content")
    damaged = packed.withColumn("block", packed.block.substr(2, 3))
    assert not archive.unpack_containers(damaged).first().intact


def test_records_once(spark):
    line = lambda t, r="a1", f="f": LINE.format(t=t, r=r, f=f)
    head = ",".join(archive.GAZE_COLUMNS)
    rows = [
        (1, "p1", f"{head}\r\n{line('1.50')}\r\n{line('2.0')}"), (2, "p2", f"{line('1.5')}\n{line('1.5', r='b')}\r{line('3e0')}\n\n"), (3, "p3", head), (4, "p4", ""),
        (5, "p5", f"{line('3.000000')}\n{line('x')}\nshort\n{line('x')}"),
    ]
    df = files(spark, rows)
    records = archive.gaze_file_records(archive.intact_files(archive.pack_containers(df, "file_id", "path", "content")))
    assert records.count() == 9
    assert sorted((r.ts_us, r.n) for r in archive.repeated_records(records).collect()) == [(1_500_000, 2), (3_000_000, 2)]
    once = archive.gaze_file_records(archive.intact_files(archive.consolidate(df, "file_id", "path", "content"))).collect()
    assert sorted(r.line for r in once) == sorted([line("1.50"), line("2.0"), line("1.5", r="b"), line("3e0"), line("x"), line("x"), "short"])


def test_empty(spark):
    none = files(spark, [])
    assert archive.pack_containers(none, "file_id", "path", "content").count() == 0
    assert archive.consolidate(none, "file_id", "path", "content").count() == 0
