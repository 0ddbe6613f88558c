"""Contexts over long gaps, letters that grow in lower case, and folders that a cluster shares."""

import random
import zlib

import numpy as np
import pytest

from docflow.llm import packing, pii, queries
from docflow.llm.common import shared_dir


@pytest.mark.parametrize("gap", [" ", " " * 170, "\n\t" * 300, " - " * 200])
def test_contexts_reach_over_any_white_space(spark, gap):
    """A label that announces known numbers announces an unknown one, however far away it stands."""
    rows = [(i, f"w{chr(97 + i % 20)} please call me at{gap}+1 (555) 010-{1000 + i} thanks v{chr(97 + i % 17)}") for i in range(12)]
    rows += [(50, f"please call me at{gap}5550109999 thanks"), (51, "the year 55501 was fine"), (52, None)]
    got = {r.doc_id: r for r in pii.report(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[50].n_added == 1 and "ctx_phone" in got[50].spans and got[51].n_added == 0 and got[0].n_phone == 1 and got[52].n_added == 0


def test_ids_are_the_tokenizers_own(spark):
    """Words with letters whose lower case is more than letters, marks, signs and digits in any mix."""
    from tokenizers import Tokenizer

    rng = random.Random(6)
    signs = list("aZéßİıΣς9.,|-_'̇İx1(<") + ["😀", "中"]
    texts = [" ".join("".join(rng.choices(signs, k=rng.randint(1, 8))) for _ in range(6)) for _ in range(1500)] + ["İ.", "aİ, b", "İ|x", None, ""]
    own = Tokenizer.from_file(queries.tokenizer_path())
    got = packing.Encoder(queries.tokenizer_path())(texts)
    for t, ids in zip(texts, got):
        want = [*own.encode(t or "", add_special_tokens=False).ids, 1]
        assert ids.tolist() == want, t
    assert zlib.crc32(np.array(want, "<u4").tobytes()) == zlib.crc32(np.array([1], "<u4").tobytes())


def test_shared_folders(spark):
    assert shared_dir(spark, "x").startswith("file:///tmp/spark-")

    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

            getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda *a: None)}))

    with pytest.raises(ValueError, match="share"):
        shared_dir(Cluster, "x")
