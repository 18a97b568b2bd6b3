"""Picture headers, documents with a commit, deletes in order, and a drain that remembers."""

import os
import time

import pytest
from pyspark.sql import functions as F

from sheetspark.kernels import jpeg
from sheetspark.queries import tagged
from sheetspark.sources import deletes, documents, files, pictures
from sheetspark.sources.synthetic import drawn
from sheetspark.streaming import drain

PAGE = jpeg.encode(drawn(1), 50)


def png(width, height, colour):
    return b"\x89PNG\r\n\x1a\n" + b"\0\0\0\x0dIHDR" + width.to_bytes(4) + height.to_bytes(4) + bytes([8, colour, 0, 0, 0])


def test_headers_without_pictures(spark, tmp_path):
    long = jpeg.segment(0xE2, b"x" * 65_000) * 3  # the frame is far behind
    (tmp_path / "a").mkdir()
    made = {
        "a/plain.jpg": PAGE,
        "a/turned.jpg": tagged(PAGE, 6),
        "a/far.jpg": PAGE[:2] + long + PAGE[2:],
        "grey.png": png(7, 9, 0),
        "colour.png": png(7, 9, 2),
        "phone.heic": b"\0\0\0\x18ftypheic" + b"\0" * 20,
        "text.jpg": b"no picture",
        "empty.jpg": b"",
        "cut.jpg": PAGE[:40],
        "_hidden.jpg": PAGE,
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    rows = {r["path"].removeprefix(f"file://{tmp_path}/"): r for r in pictures.picture_files(spark, str(tmp_path)).collect()}
    assert set(rows) == set(made) - {"_hidden.jpg"}
    size = {n: (r["kind"], r["width"], r["height"], r["grey"], r["orientation"], r["upright_width"]) for n, r in rows.items() if r["error"] is None}
    assert size == {
        "a/plain.jpg": ("jpeg", 240, 320, False, 1, 240),
        "a/turned.jpg": ("jpeg", 240, 320, False, 6, 320),
        "a/far.jpg": ("jpeg", 240, 320, False, 1, 240),
        "grey.png": ("png", 7, 9, True, 1, 7),
        "colour.png": ("png", 7, 9, False, 1, 7),
    }
    assert "HEIC" in rows["phone.heic"]["error"] and all(rows[n]["error"] for n in ("text.jpg", "empty.jpg", "cut.jpg"))
    assert all(rows[n]["length"] == len(made[n]) and rows[n]["modified"] is not None for n in rows)
    some = pictures.picture_files(spark, str(tmp_path), pattern="*.png", recursive="false", content="true").collect()
    assert {bytes(r["content"]) for r in some} == {made["grey.png"], made["colour.png"]}
    assert pictures.picture_files(spark, f"{tmp_path}/a", pattern="none").count() == 0


def test_tasks_have_ranges_of_files_by_bytes(tmp_path, monkeypatch):
    for k in range(7):
        (tmp_path / f"{k}.jpg").write_bytes(PAGE)
    monkeypatch.setattr(pictures, "TASK_BYTES", 3 * pictures.HEADER_BYTES)
    reader = pictures.PictureReader({"path": str(tmp_path)}, None)
    assert [len(p.rows) for p in reader.partitions()] == [3, 3, 1]


def pages_of(spark, rows):
    return spark.createDataFrame([(s, n, bytearray(d) if d is not None else None) for s, n, d in rows], "scan_id string, num int, jpeg binary")


def test_documents_are_whole_and_replaced(spark, tmp_path):
    folder = str(tmp_path / "out")
    documents.write_documents(pages_of(spark, [("a", 2, PAGE), ("a", 1, tagged(PAGE, 3)), ("b", 1, PAGE)]), folder)
    assert sorted(os.listdir(folder)) == ["a.pdf", "b.pdf"]
    data = (tmp_path / "out/a.pdf").read_bytes()
    assert data.count(b"/Type /Page ") == 2 and data.index(tagged(PAGE, 3)) < data.rindex(PAGE[:2] + PAGE[2:60])
    documents.write_documents(pages_of(spark, [("a", 1, PAGE)]), folder)
    assert (tmp_path / "out/a.pdf").read_bytes().count(b"/Type /Page ") == 1 and sorted(os.listdir(folder)) == ["a.pdf", "b.pdf"]
    documents.write_documents(pages_of(spark, [("a", 3, PAGE), ("c", 12, PAGE)]), folder, kind="pages")
    assert (tmp_path / "out/a/page/0003.jpg").read_bytes() == PAGE and (tmp_path / "out/c/page/0012.jpg").exists()


@pytest.mark.parametrize("bad", [("z", 1, b"no picture"), ("z", 1, None), ("z", None, PAGE), ("..", 1, PAGE), ("b", 1, PAGE)])
def test_a_failed_job_leaves_what_was(spark, tmp_path, bad):
    folder = str(tmp_path / "out")
    documents.write_documents(pages_of(spark, [("a", 1, PAGE)]), folder)
    before = (tmp_path / "out/a.pdf").read_bytes()
    with pytest.raises(Exception, match="."):
        documents.write_documents(pages_of(spark, [("a", 1, PAGE), ("a", 2, PAGE), ("b", 1, PAGE), bad]), folder)
    assert os.listdir(folder) == ["a.pdf"] and (tmp_path / "out/a.pdf").read_bytes() == before


def test_two_tasks_with_one_document_are_refused(tmp_path):
    writer = documents.DocumentWriter(str(tmp_path), "documents")
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"scan_id": ["a"], "num": [1], "jpeg": [PAGE]})
    one, two = writer.write(iter([rows])), writer.write(iter([rows]))
    with pytest.raises(ValueError, match="two tasks"):
        writer.commit([one, two, None])
    assert os.listdir(tmp_path) == []
    again = documents.DocumentWriter(str(tmp_path), "documents")
    again.write(iter([rows]))  # an attempt that was lost
    again.commit([again.write(iter([rows]))])
    assert os.listdir(tmp_path) == ["a.pdf"]


def test_only_a_pdf_takes_a_quality(spark, tmp_path):
    files.write_output(spark, f"{tmp_path}/a.pdf", [drawn(1)], 40)
    with pytest.raises(ValueError, match="quality"):
        files.write_output(spark, f"{tmp_path}/a.jpg", [drawn(1)], 40)
    assert not (tmp_path / "a.jpg").exists()


def test_deletes_in_order_from_wherever_they_stopped(spark, tmp_path):
    for s in ("s1", "s2"):
        for kind in ("page", "photo", "state"):
            os.makedirs(tmp_path / s / kind)
        for n in (1, 2):
            for path in (f"photo/{n:04d}.jpg", f"page/{n:04d}.jpg", f"state/{n:04d}.txt"):
                (tmp_path / s / path).write_bytes(b"x")
        (tmp_path / s / "scan.pdf").write_bytes(b"x")
    steps = deletes.retakes(spark.createDataFrame([("s1", 2), ("s2", 1), ("s2", 2)], "scan_id string, num int"))
    rows = [(r["scan_id"], r["step"], r["path"]) for r in steps.orderBy("scan_id", "step").collect()]
    assert rows[:4] == [("s1", 1, "scan.pdf"), ("s1", 2, "page/0002.jpg"), ("s1", 3, "state/0002.txt"), ("s1", 4, "photo/0002.jpg")]
    assert [p for s, _, p in rows if s == "s2"] == ["scan.pdf", "page/0001.jpg", "page/0002.jpg", "state/0001.txt", "state/0002.txt", "photo/0001.jpg", "photo/0002.jpg"]
    # a step that can't be taken stops its scan, and only that
    os.remove(tmp_path / "s2/page/0002.jpg")
    os.makedirs(tmp_path / "s2/page/0002.jpg")
    got = {(r["scan_id"], r["path"]): (r["gone"], r["error"]) for r in deletes.run(steps, str(tmp_path)).collect()}
    assert all(gone for (s, _), (gone, _) in got.items() if s == "s1")
    assert [got["s2", p][0] for _, _, p in rows[4:]] == [True, True, False, False, False, False, False]
    assert (tmp_path / "s2/photo/0001.jpg").exists() and (tmp_path / "s1/photo/0001.jpg").exists() and not (tmp_path / "s1/photo/0002.jpg").exists()
    os.rmdir(tmp_path / "s2/page/0002.jpg")
    assert all(r["gone"] for r in deletes.run(steps, str(tmp_path)).collect())
    assert os.listdir(tmp_path / "s2/photo") == [] and os.listdir(tmp_path / "s1/page") == ["0001.jpg"]
    bad = spark.createDataFrame([("s1", 1, "../s2/photo"), ("..", 1, "x")], "scan_id string, step int, path string")
    assert all(not r["gone"] and "leaves" in r["error"] for r in deletes.run(bad, str(tmp_path)).collect())


def shoot(root, scan, num, data):
    os.makedirs(f"{root}/{scan}/photo", exist_ok=True)
    with open(f"{root}/{scan}/photo/{num:04d}.jpg", "wb") as f:
        f.write(data)


def test_failures_outlive_a_restart(spark, tmp_path):
    root, clock = f"{tmp_path}/scans", [1000.0]
    known = lambda: drain.Failures(spark, f"{tmp_path}/failed", most_tries=3, wait=10, now=lambda: clock[0])
    photo = jpeg.encode(drawn(2), 80)
    shoot(root, "s", 1, photo)
    shoot(root, "s", 2, b"no picture")
    counts = []
    run = lambda: drain.watch(spark, root, f"{tmp_path}/check", counts.append, failures=known()).awaitTermination()
    run()
    assert counts == [1] and [(r["num"], r["tries"], r["retry_at"]) for r in known().read().collect()] == [(2, 1, 1010.0)]
    left = lambda: {r["num"] for p in drain.drained(spark, root, failures=known()) for r in p.collect()}
    assert left() == set()
    clock[0] = 1011.0
    assert left() == {2}
    for wait in (20.0, 40.0):
        known().note({("s", 2)}, drain.listing(spark, root))
        assert known().read().first()["retry_at"] == clock[0] + wait
        clock[0] += wait + 1
    assert left() == set() and known().read().first()["tries"] == 3  # often enough
    # a new file of that number is tried at once, and forgotten when it has its page
    time.sleep(1.1)
    shoot(root, "s", 2, photo)
    shoot(root, "s", 3, b"bad")
    assert left() == {2, 3}
    run()
    assert counts == [1, 1] and [(r["num"], r["tries"]) for r in known().read().collect()] == [(3, 1)]


def test_all_of_a_drain_in_batches(spark, tmp_path):
    for n in range(1, 6):
        shoot(tmp_path, "st"[n % 2], n, PAGE)
    parts = [{(r["scan_id"], r["num"]) for r in p.collect()} for p in drain.drained(spark, str(tmp_path), most=2)]
    assert [len(p) for p in parts] == [2, 2, 1] and set().union(*parts) == {("st"[n % 2], n) for n in range(1, 6)}


def test_a_drain_that_stays_on(spark, tmp_path):
    root = f"{tmp_path}/scans"
    shoot(root, "s", 1, PAGE)
    counts = []
    query = drain.watch(spark, root, f"{tmp_path}/check", counts.append, every=1)
    try:
        for want, num in (([1], 2), ([1, 1], None)):
            for _ in range(120):
                if counts == want:
                    break
                time.sleep(0.5)
            assert counts == want
            if num:
                shoot(root, "s", num, PAGE)
        assert query.isActive
    finally:
        query.stop()


def test_incomplete_pictures_are_errors(spark):
    from sheetspark.operators import images

    rows = [(1, x, y, 1, 2, 3) for x in range(3) for y in range(2)] + [(2, x, 0, 9, 9, 9) for x in (0, 2)] + [(3, 0, 0, 1, 1, 1)] * 2
    out = {r["k"]: r for r in images.from_pixels(spark.createDataFrame(rows, "k long, x int, y int, r int, g int, b int"), "k").collect()}
    assert out[1]["image"]["width"] == 3 and out[1]["error"] is None
    assert out[2]["image"] is None and "2 pixels" in out[2]["error"] and out[3]["error"]
    assert images.to_pixels(spark.createDataFrame(list(out.values())).select("k", F.col("image")), "k").count() == 6
