import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnfield.operators.images import DIM, featurize_images, picture_vector
from cairnfield.sources.files import list_files, read_images, scan_corpus
from pictures import cluster_pixel, png


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("pics")
    os.makedirs(root / "sub")
    for c in range(4):
        for v in range(3):
            png(root / "sub" / f"c{c}_v{v}.png", cluster_pixel(c, v))
    (root / "broken.jpg").write_bytes(b"\xff\xd8\xffnot a picture")
    (root / "notes.TXT").write_text("hello")
    return str(root)


def test_scan_and_listing(spark, folder):
    names = [os.path.basename(r.path) for r in scan_corpus(spark, folder).select("path").collect()]
    assert sorted(names)[0] == "broken.jpg" and len(names) == 13
    every = [r.path for r in list_files(spark, [folder]).select("path").collect()]
    assert len(every) == 14 and every == sorted(every)
    plan = scan_corpus(spark, folder).select("path", "size")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_clusters_and_quarantine(spark, folder):
    ok, bad = featurize_images(read_images(spark, folder).filter(~F.col("image.origin").endswith(".TXT")))
    assert [os.path.basename(r.path) for r in bad.collect()] == ["broken.jpg"]
    rows = {os.path.basename(r.path)[:-4]: np.array(r.vec) for r in ok.collect()}
    assert all(len(v) == DIM and abs(np.linalg.norm(v) - 1) < 1e-4 for v in rows.values())
    for name, v in rows.items():
        near = sorted((k for k in rows if k != name), key=lambda k: -(rows[k] @ v))[:2]
        assert all(k[:2] == name[:2] for k in near)


def _picture(pixel, w, h):
    return np.array([[pixel(x, y) for x in range(w)] for y in range(h)], dtype=np.uint8)


def test_resize_hue_and_determinism():
    base = _picture(cluster_pixel(0, 0), 96, 72)
    double = base.repeat(2, 0).repeat(2, 1)
    v = picture_vector(base)
    assert v @ picture_vector(double) > 0.95
    assert (picture_vector(base) == v).all()
    assert v @ picture_vector(_picture(cluster_pixel(0, 2), 96, 72)) > v @ picture_vector(_picture(cluster_pixel(1, 0), 96, 72))


def test_flat_square_picture():
    v = picture_vector(np.full((40, 40, 3), 90, dtype=np.uint8))
    assert abs(np.linalg.norm(v) - 1) < 1e-9
    assert v[-1] == 0


def test_orientation_is_undone(spark):
    upright = _picture(cluster_pixel(2, 0), 96, 72)
    turns = {1: upright, 2: upright[:, ::-1], 3: upright[::-1, ::-1], 4: upright[::-1], 6: np.rot90(upright, 1), 8: np.rot90(upright, 3)}
    rows = [
        ((str(o), p.shape[0], p.shape[1], 3, 16, bytearray(np.ascontiguousarray(p[:, :, ::-1]).tobytes())), o) for o, p in turns.items()
    ]
    schema = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>, o int"
    ok, bad = featurize_images(spark.createDataFrame(rows, schema), "o")
    assert bad.count() == 0
    want = picture_vector(upright)
    for r in ok.collect():
        assert np.allclose(r.vec, want, atol=1e-5), r.path
