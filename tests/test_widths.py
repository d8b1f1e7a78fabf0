"""Line lengths of texts of many lines."""

import time

from pyspark.sql import functions as F

from quillsift.functions import native
from quillsift.operators import layout


def test_widths_of_many_lines(spark):
    """A text of thousands of lines of other lengths takes no longer than its lines do, and gives what the layout stage finds."""
    texts = ["\n".join("x" * (41 + i * 7919 % 3001) + " " * (i % 3) for i in range(3000)), "\n".join("y" * n for n in (50, 51, 54, 55, 58, 90, 91, 92, 94, 95, 41, 40)), "", None, "z" * 60]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    start = time.time()
    got = {r.id: r.w for r in df.select("id", native.width_cluster(F.col("t")).alias("w")).collect()}
    assert time.time() - start < 15
    assert got[2] is None and got[3] is None and tuple(got[4]) == (1, 1, 0)
    for i in (0, 1):
        sizes = [n for x in texts[i].split("\n") if (n := len(x.rstrip())) > 40]
        assert got[i].width == layout.terminal_width(texts[i].split("\n")) and got[i].long_lines == len(sizes)
        assert got[i].cluster == max(sum(a <= b <= a + 4 for b in sizes) for a in sizes)
