import tracemalloc

import numpy as np
import pytest

from quarrylog.llm import langid, toxicity


def test_a_pass_of_the_language_network_holds_little():
    texts = [np.random.default_rng(i).integers(97, 123, 3000, np.uint8).tobytes() for i in range(300)]
    network = langid.ByteNetwork(["a", "b", "c"])
    tracemalloc.start()
    found = network.judge(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12e6
    assert np.allclose(found, network.judge(texts, 512), atol=1e-6)


@pytest.mark.parametrize("column", ["text", "TEXT"])
def test_texts_go_to_python_once(spark, column):
    docs = spark.createDataFrame([(1, "some words"), (2, None), (3, "")], f"doc_id long, {column} string")
    field = toxicity.Field({}, -3.0, np.zeros((2, 2)), np.zeros(3))
    for out in (toxicity.tag(docs, field), langid.identify(docs, langid.ByteNetwork(["a", "b"]))):
        assert "_seen" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert [r[:2] for r in sorted(out.collect())] == [(1, "some words"), (2, None), (3, "")]
