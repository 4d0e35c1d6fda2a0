import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import plain  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder of tables with every awkward case, and one of the same tables without rows."""
    import random

    full, empty = (str(tmp_path_factory.mktemp(n)) for n in ("odd", "none"))
    extra = [(True, "s", "q", 1, "p", "n", "x", 2, 3, "k")]
    pick = random.Random(3)
    tables = {
        "documents": (plain.COLUMNS + plain.EXTRA, [(*r, *extra[0]) for r in plain.rows()]),
        "labels": (
            "doc_id long, quality int, toxic int",
            [(i, pick.randint(0, 1), pick.randint(0, 1)) for i in range(0, 110)] + [(5, None, None), (None, 0, 1), (6, 0, 1)],
        ),
        "embeddings": (
            "vec_id long, embedding array<float>, label int, x string, whitened string, component string, n string, v string, place int",
            [(i, v, 1, "x", "w", "c", "n", "v", 0) for i, v in plain.embeddings()],
        ),
        "pages": (
            "page_id long, url string, html string, rule string, size string, token string",
            [
                (i, u, "", "r", "s", "t")
                for i, u in enumerate(
                    [
                        None, "", "no scheme", "http://", "http://net/", "http://a.NET", "http://a.NET/x", "https://x.example.net/en/1?q#f",
                        "http://example.net/en", "http://example.com/de/", "http://notexample.com/de/", "http://w.org/fr/x", "http://w.org?/fr/",
                        "ftp://b.casino.org/x", "http://q.org/login/", "http://q.org/a.exe", "http://q.org/a.exe?x", "http://a://net/b",
                        "http://ads.w.org/", "http://www.net:80/x", *["http://hot.example.net/en/1"] * 20,
                    ]
                )
            ],
        ),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{full}/{name}.parquet")
        spark.createDataFrame([], schema).write.parquet(f"{empty}/{name}.parquet")
    return full, empty
