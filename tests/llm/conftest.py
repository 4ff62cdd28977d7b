import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from tablekeeper.session import get_spark
    s = get_spark("local[*]", 4, app="tablekeeper-tests")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tk-test-ckpt-"))
    from tablekeeper.llm.queries import importable
    importable(s)
    return s


WORDS = ("alder birch cedar dogwood elm fir ginkgo hazel ivy juniper katsura larch maple nutmeg oak pine quince rowan "
         "spruce teak umbra vine willow yew zelkova ash beech cherry ebony fig").split()


@pytest.fixture(scope="session")
def documents(spark):
    """Odd rows: nulls in every column, empty and very long texts, copies, near copies, repeated lines, shared passages."""
    import random
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    passage, line = say(60), say(12)
    rows = []
    for i in range(60):
        rows.append([i, "\n".join([say(rng.randrange(1, 60)), line if i % 3 == 0 else say(9), say(30)]), "en", "src0", 1])
    for i in range(60, 75):
        rows.append([i, say(40) + " " + passage + "\n" + say(20), "de" if i % 2 else None, "src1", 2])
    base = say(120).split()
    for i in range(75, 95):
        own = list(base)
        for _ in range(rng.randrange(0, 6)):
            own[rng.randrange(len(own))] = say(1)
        rows.append([i, " ".join(own), "en", None, None])
    rows += [[95, rows[3][1], "en", "src0", 1], [96, rows[3][1], "en", "src0", 1], [97, rows[3][1].upper(), "en", "src0", 1]]
    rows += [[98, None, None, None, None], [99, "", "en", "src0", 0], [100, " \n\t \x0b\n", "en", "src0", 5], [101, "one", "fr", "src0", 3],
             [102, "one", "fr", "src0", 3], [103, "é ü ñ 漢字 😀 " * 30, "es", "src0", 1], [104, "ab" * 700, "en", "src2", 1],
             [105, say(20000), "en", "src2", 1], [106, "same words " * 400, "en", "src2", 1], [107, "a\r\nb\x00c\n\n\nd", "en", "src2", 1]]
    rows.append(list(rows[7]))                     # a row twice
    rng.shuffle(rows)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame([tuple(r) for r in rows], schema).repartition(5).cache()


@pytest.fixture(scope="session")
def clashing(documents):
    """The documents with columns named as operators name theirs, and a row without id."""
    from pyspark.sql import functions as F
    extra = documents.withColumns({c: F.lit(1) for c in ("block", "part", "kept", "class", "component", "note", "n", "role")})
    return extra.unionByName(extra.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.where("false")
