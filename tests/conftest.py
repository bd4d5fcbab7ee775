import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from orbitlake import session
    s = session("tests", **{"spark.master": "local[8]", "spark.ui.enabled": "false",
                            "spark.ui.showConsoleProgress": "false",
                            "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def image_rows(array, frame=0, scene=None, name="v"):
    """Rows of a 2-D array; NaN becomes NULL."""
    rows = []
    for (r, c), v in np.ndenumerate(np.asarray(array, dtype=float)):
        head = (frame,) if scene is None else (frame, scene)
        rows.append((*head, r, c, None if np.isnan(v) else float(v)))
    return rows


@pytest.fixture
def image(spark):
    def make(array, name="v", frame=0):
        from orbitlake.operators.stencil import sized
        h, w = np.asarray(array).shape
        df = spark.createDataFrame(image_rows(array, frame),
                                   f"frame_id int, row int, col int, {name} double")
        return sized(df, h, w)
    return make


@pytest.fixture
def stack(spark):
    def make(arrays, name="red"):
        from orbitlake.operators.stencil import sized
        rows = [row for i, a in enumerate(arrays) for row in image_rows(a, 0, i)]
        df = spark.createDataFrame(rows, f"frame_id int, scene_ord int, row int, col int, "
                                         f"{name} double")
        scenes = spark.createDataFrame([(0, i) for i in range(len(arrays))],
                                       "frame_id int, scene_ord int")
        return sized(df, *np.asarray(arrays[0]).shape), scenes
    return make


def to_array(df, name, shape):
    out = np.full(shape, np.nan)
    for r, c, v in df.select("row", "col", name).collect():
        out[r, c] = np.nan if v is None else v
    return out
