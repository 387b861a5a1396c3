import difflib
import random
import struct

import numpy as np
from pyspark.sql import functions as F

from evidentia.operators import grammar as G
from evidentia.operators import metadata as M
from evidentia.plans.pipeline import run_pipeline
from evidentia.sources import readers


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_lemmas_keywords_triples(spark):
    assert one(spark, G.lemmas(F.lit("The politicians are debating loudly!"))) == ["politician", "debate", "loudly"]
    assert one(spark, G.lemmas(F.lit("stopped studies boxes makes was running"))) == ["stop", "study", "box", "make", "run"]
    k = one(spark, G.keywords(F.lit("Famous senators signed the bill")))
    assert k == ["senators", "bill", "signed", "famous"]
    t = one(spark, G.triple(F.lit("President Smith signed the climate bill.")))
    assert tuple(t) == ("President Smith", "signed", "the climate bill")
    assert tuple(one(spark, G.triple(F.lit(None).cast("string")))) == (None, None, None)
    assert one(spark, G.overlap_ratio(F.lit("abcd"), F.lit("BCDE"))) == 0.75 and one(spark, G.overlap_ratio(F.lit(""), F.lit("x"))) == 0


def jpeg_with_exif():
    def entry(tag, kind, count, value):
        return struct.pack("<HHI", tag, kind, count) + value

    date = b"2019:07:01 10:00:00\0"
    ifd = struct.pack("<H", 3) + entry(0x0112, 3, 1, struct.pack("<HH", 6, 0)) + entry(0x0132, 2, len(date), struct.pack("<I", 200)) + entry(0x8769, 4, 1, struct.pack("<I", 100)) + b"\0\0\0\0"
    sub = struct.pack("<H", 2) + entry(0x829A, 5, 1, struct.pack("<I", 240)) + entry(0x9003, 2, len(date), struct.pack("<I", 200)) + b"\0\0\0\0"
    tiff = bytearray(300)
    tiff[:8] = b"II*\0" + struct.pack("<I", 8)
    tiff[8 : 8 + len(ifd)], tiff[100 : 100 + len(sub)] = ifd, sub
    tiff[200 : 200 + len(date)], tiff[240:248] = date, struct.pack("<II", 1, 125)
    body = b"Exif\0\0" + bytes(tiff)
    sof = struct.pack(">BHHB", 8, 480, 640, 3) + b"\0" * 9
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xc0" + struct.pack(">H", len(sof) + 2) + sof + b"\xff\xda\0\2"


def test_headers_and_exif(spark):
    j = jpeg_with_exif()
    assert M.dimensions(j) == (640, 480)
    assert M.exif(j) == {"Orientation": "6", "DateTime": "2019:07:01 10:00:00", "DateTimeOriginal": "2019:07:01 10:00:00", "ExposureTime": "1/125"}
    assert M.dimensions(b"GIF89a" + struct.pack("<HH", 3, 5)) == (3, 5) and M.dimensions(b"junk") == (0, 0) and M.exif(j[:60]) == {"Orientation": "6"} and M.exif(j[:30]) == {}
    rows = M.metadata(spark.createDataFrame([("a", bytearray(j)), ("b", None)], "path string, content binary")).collect()
    got = {r["path"]: r for r in rows}
    assert (got["a"]["width"], got["a"]["exif"]["Orientation"]) == (640, "6") and (got["b"]["sha256_hash"], got["b"]["file_size_bytes"]) == ("", 0)


def test_pixel_hashes(spark):
    rng = np.random.default_rng(0)
    px = rng.integers(0, 255, (64, 64), dtype=np.uint8)
    near = np.clip(px.astype(int) + rng.integers(-4, 5, px.shape), 0, 255).astype(np.uint8)
    rows = [(n, 64, 64, 1, bytearray(p.tobytes())) for n, p in (("a", px), ("near", near), ("other", px[::-1].copy()))] + [("none", None, None, None, None)]
    got = {r["id"]: r for r in M.pixel_hashes(spark.createDataFrame(rows, "id string, height int, width int, nChannels int, data binary")).collect()}
    bits = lambda a, b, k: bin(int(got[a][k], 16) ^ int(got[b][k], 16)).count("1")
    for k in ("phash", "dhash", "ahash"):
        assert len(got["a"][k]) == 16 and bits("a", "near", k) <= 6 < bits("a", "other", k) and got["none"][k] == ""


def test_social_news(spark, tmp_path):
    head = "\tUnnamed: 0\tUnnamed: 0.1\tUnnamed: 0.1.1\tauthor\tclean_title\tcreated_utc\tdomain\thasImage\tid\timage_url\tlinked_submission_id\tnum_comments\tscore\tsubreddit\ttitle\tupvote_ratio\t2_way_label\t3_way_label\t6_way_label"
    (tmp_path / "n.tsv").write_text(head + "\n0\t1\t\t\tann\tthe title\t1.5e9\ta.com\tTrue\tid1\thttp://i\t\t3\t10\tnews\tThe Title\t0.9\t1\t0\t2\n")
    r = readers.social_news(spark, str(tmp_path / "n.tsv")).first()
    assert (r["author"], r["hasImage"], r["created_utc"], r["6_way_label"], r["linked_submission_id"]) == ("ann", True, 1.5e9, 2, None)


def test_submission_to_report(spark):
    docs = spark.createDataFrame(
        [
            (1, "Officials confirmed the nationwide 5G ban on Monday. The weather was mild in most places. Shops stayed open all day long.", "https://bbc.com/news/1", "a"),
            (2, "A hoax about the nationwide 5G ban was debunked today. Cats slept in the sun all day. Dogs ran along the river bank.", "https://www.altnews.in/2", "b"),
            (3, "Cats sleep most of the day. Dogs like to run in the park. Birds sing early in the morning.", "https://example.org/3", "c"),
        ],
        "doc_id long, text string, url string, title string",
    )
    subs = spark.createDataFrame([(1, "Government announced a nationwide 5G ban"), (2, "Zebras painted the moonlit aqueduct purple"), (3, " ")], "submission_id long, text string")
    run = run_pipeline(subs, docs)
    ev = run.evidence.collect()
    assert {(r["submission_id"], r["document_id"], r["relationship"]) for r in ev} == {(1, 1, "SUPPORTS"), (1, 2, "CONTRADICTS")}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["evidence_text"] in texts[r["document_id"]] for r in ev) and sorted(r["seq"] for r in ev) == [1, 2]
    got = {r["submission_id"]: r["overall_status"] for r in run.verdicts.collect()}
    assert got == {1: "LIKELY_MISLEADING", 2: "UNVERIFIED"}
    assert {r["submission_id"] for r in run.reports.collect()} == {1, 2}


def test_matching_ratio_is_difflibs():
    rng = random.Random(5)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    pairs = [(word(rng.randrange(60), s), word(rng.randrange(60), s)) for s in ("ab", "abcde ", "aé₹😀 z") for _ in range(300)]
    pairs += [(word(n, "abc d"), word(m, "abc d")) for n in (1, 7, 8, 9, 190, 260) for m in (1, 7, 8, 9, 15, 16, 199, 200, 240)] + [("", "a"), ("a", ""), ("", ""), ("aaaa", "aaaaaaa")]
    for a, b in pairs:
        assert G.matching_ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()
