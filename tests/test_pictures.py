import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import images as I
from evidentia.operators import jpeg as J
from evidentia.operators import keypoints as K
from evidentia.operators import ocr as O
from evidentia.operators import variants as V
from evidentia.plans.queries import QUERIES, textured

PICTURE = "id string, height int, width int, nChannels int, data binary"


def frame(spark, pictures):
    rows = [(str(i), p.shape[0], p.shape[1], 1 if p.ndim == 2 else p.shape[2], bytearray(p.tobytes())) for i, p in enumerate(pictures)]
    return spark.createDataFrame([*rows, ("none", 4, 4, 1, None), ("short", 9, 9, 3, bytearray(5))], PICTURE)


@pytest.mark.parametrize("seed", range(4))
def test_copies_score_and_others_do_not(seed):
    v = np.random.default_rng(seed).normal(0, 1, 64)
    assert K.copy_move_score(textured(v, 200, True)) > 0.5 and K.copy_move_score(textured(v, 200, False)) < 0.1


def test_a_copy_in_a_large_picture():
    img = textured(np.ones(8), 900, False)
    img[600:800, 620:820] = img[30:230, 40:240]
    assert K.copy_move_score(img) > 0.5


def test_turned_part_is_found():
    img = textured(np.arange(8), 200, False)
    img[120:180, 120:180] = np.rot90(img[20:80, 20:80])
    assert K.copy_move_score(img) > 0.5


def test_neighbours_against_pairs():
    words = np.random.default_rng(1).integers(0, 2**63, (300, 4)).astype(np.uint64)
    words[200:210] = words[:10]
    near, bits = K.neighbours(words, 4)
    for i in range(300):
        d = [(sum(bin(int(a ^ b)).count("1") for a, b in zip(words[i], w)), j) for j, w in enumerate(words)]
        assert list(zip(bits[i].tolist(), near[i].tolist())) == sorted(d)[:4]


def test_pictures_without_corners():
    for img in (np.zeros((200, 200), np.uint8), np.zeros((3, 5), np.uint8), np.full((1, 400), 9, np.uint8)):
        assert K.copy_move_score(img) == 0.0


def test_copy_moves_table(spark):
    got = {r["id"]: r for r in K.copy_moves(frame(spark, [textured(np.ones(4), 160, True), np.zeros((50, 50), np.uint8)])).collect()}
    assert got["0"]["copy_move"] > 0.5 and got["0"]["n_keypoints"] >= 50
    assert all(got[i]["n_copies"] == 0 for i in ("1", "none", "short"))


def test_pictures_of_a_small_table_are_dealt_over_the_cores(spark):
    """A table of one file is one task's scan; the pictures drawn from it are not."""
    parts = QUERIES["copy_moves"](spark, "/root/testdata/sf0.001").select("id", F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < sum(r["count"] for r in parts) / 2


def test_coefficients_against_sql():
    """Cosine sums of three blocks, by SQL."""
    plane = np.random.default_rng(2).integers(0, 256, (8, 24)).astype(float)
    con = duckdb.connect()
    con.execute("CREATE TABLE p (b INT, y INT, x INT, v DOUBLE)")
    con.executemany("INSERT INTO p VALUES (?, ?, ?, ?)", [(x // 8, y, x % 8, plane[y, x]) for y in range(8) for x in range(24)])
    rows = con.execute(
        """SELECT b, k, l, sum((v - 128) * cos((2 * y + 1) * k * pi() / 16) * cos((2 * x + 1) * l * pi() / 16))
                  * (CASE WHEN k = 0 THEN sqrt(0.125) ELSE 0.5 END) * (CASE WHEN l = 0 THEN sqrt(0.125) ELSE 0.5 END) AS c
           FROM p, range(8) a(k), range(8) c(l) GROUP BY b, k, l"""
    ).fetchall()
    got = J.coefficients(plane)
    assert len(rows) == 192 and all(abs(got[0, b, k, l] - c) < 1e-8 for b, k, l, c in rows)


def test_saving():
    grey = np.full((30, 41, 3), 77, np.uint8)
    assert np.abs(J.saved(grey).astype(int) - 77).max() <= 1
    noise = np.random.default_rng(3).integers(0, 256, (37, 50, 3)).astype(np.uint8)
    far = [np.abs(J.saved(noise, q).astype(int) - noise).mean() for q in (95, 75, 30)]
    assert J.saved(noise).shape == noise.shape and far == sorted(far)
    assert J.steps(J.LUMA, 50).ravel().tolist() == J.LUMA and J.steps(J.LUMA, 90)[0, 0] == 3 and J.steps(J.LUMA, 100).max() == 1
    smooth = K.blurred(np.random.default_rng(4).normal(128, 90, (64, 64)), 3, 9).clip(0, 255).astype(np.uint8)
    once = J.saved(np.dstack([smooth] * 3))
    assert np.abs(J.saved(once).astype(int) - once).mean() < np.abs(once.astype(int) - smooth[..., None]).mean()


def test_part_with_another_history_stands_out():
    base = K.blurred(np.random.default_rng(5).normal(128, 60, (96, 96)), 2, 6).clip(0, 255).astype(np.uint8)
    old = J.saved(np.dstack([base] * 3))
    forged = old.copy()
    forged[30:60, 30:60] = np.random.default_rng(6).integers(0, 256, (30, 30, 3))
    assert I.ela_score(forged) > I.ela_score(old) and 0 <= I.ela_score(old) <= 1


def bars(degrees):
    img = np.full((160, 240), 240, np.uint8)
    for y in range(50, 110, 12):
        img[y : y + 6, 60:180] = 20
    return np.dstack([V.rotated(img, degrees)] * 3)


@pytest.mark.parametrize("degrees", [7.0, -7.0, 20.0, -33.0, 2.0])
def test_deskewing(degrees):
    assert abs(V.skew(V.to_gray(bars(degrees))) - degrees) < 0.5
    back = V.all_variants(bars(degrees))["deskewed"]
    assert abs(V.skew(V.to_gray(back))) < 0.5 and back.shape == (160, 240, 3)


def test_straight_empty_and_tiny_pictures():
    assert "deskewed" not in V.all_variants(bars(0.0))
    for shape in ((1, 1, 3), (2, 5, 3), (40, 3, 3)):
        got = V.all_variants(np.full(shape, 200, np.uint8))
        assert got["original"].shape == shape and got["adaptive_thresh"].shape == (2 * shape[0], 2 * shape[1])


def test_hull_and_rectangle_against_all_angles():
    rng = np.random.default_rng(7)
    for _ in range(20):
        pts = rng.integers(0, 40, (60, 2))
        h = V.hull(pts)
        d = np.roll(h, -1, 0) - h
        for p in pts:
            assert (d[:, 0] * (p[1] - h[:, 1]) - d[:, 1] * (p[0] - h[:, 0]) >= 0).all()
        img = np.full((40, 40), 250, np.uint8)
        img[pts[:, 1], pts[:, 0]] = 0
        if (img == 0).sum() >= 40:
            V_dark, V.DARK = V.DARK, 1
            t = np.radians(V.skew(img))
            V.DARK = V_dark
            area = lambda a: np.ptp(pts @ [np.cos(a), np.sin(a)]) * np.ptp(pts @ [-np.sin(a), np.cos(a)])
            assert area(t) <= min(area(a) for a in np.linspace(0, np.pi / 2, 400)) * 1.0001


def test_contrast_smoothing_threshold():
    dim = np.tile(np.arange(100, 116, dtype=np.uint8), (64, 4))
    assert np.ptp(V.contrast(dim)) > 2 * np.ptp(dim)
    step = np.where(np.arange(64) < 32, 20, 230).astype(np.uint8)[None].repeat(40, 0)
    noisy = (step + np.random.default_rng(8).normal(0, 6, step.shape)).clip(0, 255).astype(np.uint8)
    smooth = V.bilateral(noisy)
    assert smooth[:, :28].std() < 0.6 * noisy[:, :28].std() and np.abs(smooth[:, 31].mean() - smooth[:, 32].mean()) > 120
    black = V.local_threshold(bars(0.0)[..., 0])[:, 140:340]
    assert (black[[101, 110]] == 0).all() and (black[:90] == 255).all()
    lab = np.random.default_rng(9).integers(0, 256, (9, 9, 3)).astype(np.uint8)
    assert np.abs(V.from_lab(V.to_lab(lab)).astype(int) - lab).max() <= 1


def test_variants_feed_the_consensus(spark):
    """A reader that reads straight pictures best, and one that always fails."""

    def reader(px):
        grey = px if px.ndim == 2 else V.to_gray(px)
        return [("Heavy rain", 0.95 if abs(V.skew(grey)) < 1 and grey.shape == (160, 240) else 0.4, 1.0, 1.0), ("45%", 0.9, 1.0, 50.0)]

    def broken(px):
        raise RuntimeError("no engine")

    found = V.recognised(frame(spark, [bars(9.0), bars(0.0)]), {"reader": reader, "broken": broken})
    got = {r["image_id"]: r for r in O.consensus(O.regions(found)).collect()}
    assert got["0"]["engine_used"] == "reader-deskewed" and got["0"]["text"] == "Heavy rain" and set(got) == {"0", "1"}


def test_scores_table(spark):
    got = {r["id"]: r for r in I.forensic_scores(frame(spark, [bars(3.0)])).collect()}
    assert 0 < got["0"]["ela"] <= 1 and got["none"]["ela"] == 0 and got["short"]["image_type"] == "UNREADABLE"
