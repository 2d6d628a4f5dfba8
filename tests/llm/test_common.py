import pyarrow as pa

from sheaf.llm import common, near_dedup, toxicity


def test_tasks_forget_what_other_operators_remember(monkeypatch):
    given = []
    monkeypatch.setattr(common, "_give_back", lambda: given.append(1))
    near_dedup.shingle_set("a b c", 2)
    toxicity._kept.append("scores")
    toxicity.folded(b"a")
    run = common.tidy("near_dedup", near_dedup._sets(2))
    out = next(iter(run([pa.record_batch({"text": ["a b c"]})])))
    assert out.num_rows == 1 and near_dedup._hashes and given == [1]
    assert not toxicity._kept and not toxicity.folded.cache_info().currsize


def test_free_memory_can_be_returned():
    common._give_back()
