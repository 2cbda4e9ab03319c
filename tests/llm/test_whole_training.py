"""Operator 4 learns its attention's weights from every training text, not from a sample alone."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from docquarry.llm import attention, common, scoring, subwords


def test_weights_come_from_all_texts(spark, monkeypatch):
    table = subwords.subwords()
    kind, mark = scoring.id_type(table), table.size - 1
    data = [(i, "one two three four " * 200 if i % 2 else "four three two one " * 200, False) for i in range(40)]
    coded = scoring.encoded(spark.createDataFrame(data, "doc_id long, text string, held_out boolean").repartition(3), None).persist()
    monkeypatch.setattr(scoring, "sample", lambda *a: [])  # what no sample holds is learned all the same
    m = scoring.learn(coded, table.size, kind)
    rare = attention.Model(table.size)
    flat = [np.concatenate(([mark], np.frombuffer(table.encode(t), "<u4"), [mark])).astype(np.int64) for _, t, _ in data]
    rare._tables(np.concatenate(flat), np.cumsum([0, *map(len, flat)])[:-1])
    rare.fit([])
    sizes = np.array(list(map(len, flat)))
    assert m.score(np.concatenate(flat), sizes).sum() > rare.score(np.concatenate(flat), sizes).sum() + 1


def test_a_pass_is_the_mean_over_tasks(spark):
    table = subwords.subwords()
    kind, mark = scoring.id_type(table), table.size - 1
    data = [(i, "one two three four " * (30 * i + 1), False) for i in range(4)]
    coded = scoring.encoded(spark.createDataFrame(data, "doc_id long, text string, held_out boolean").repartitionByRange(4, "doc_id"), None).persist()
    ids = [[np.frombuffer(r["ids"], kind) for r in part] for part in coded.rdd.glom().collect() if part]
    flat = [np.concatenate(([mark], x, [mark])).astype(np.int64) for part in ids for x in part]
    model = attention.Model(table.size)
    model._tables(np.concatenate(flat), np.cumsum([0, *map(len, flat)])[:-1])
    start = model.weights([])
    got = scoring.pass_over(coded, model, start, kind, mark)
    each = [model.goes_on(start, [(np.concatenate(x), np.array(list(map(len, x))))]) for x in ([np.concatenate(([mark], y, [mark])).astype(np.int64) for y in part] for part in ids)]
    seen = sum(n for _, n in each)
    assert seen == sum(len(x) - 1 for x in flat)
    for k in start:
        assert np.allclose(got[k], sum(p[k].astype(float) * n for p, n in each) / seen, atol=1e-4)


def test_pads_are_hidden_where_they_stand():
    model = attention.Model(50)
    model.pad = 9
    win = np.zeros((3, model.window), np.int32)
    win[1, :5] = model.pad
    a = np.zeros((3, model.stride, model.window), np.float32)
    model._without_pads(a, win)
    assert (a[1, :, :5] < -1e8).all() and not a[1, :, 5:].any() and not a[[0, 2]].any()


def test_stretches_that_repeat_are_encoded_once(monkeypatch):
    table = subwords.subwords()
    rng = random.Random(5)
    pieces = ["a", "don't", " ", "  ", "\n", "\t", "\xa0", " ", "　", "é", "日", "à", "\x1c", "\x85", "12", "!?", "<|endoftext|>", " the", "\r\n", "​", "😀", "\x00"]
    many = [["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(rng.randrange(1, 30))] for _ in range(200)]
    for texts in [*many, [None, "", None], ["x" + " " * 120_000 + "y z", " " * 60_000]]:
        ids, at = table.encode_all(*common.text_buffer(pa.array(texts, pa.string())))
        assert [ids[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:])] == [table.encode(t or "") for t in texts]
    done, plain = [], table._plain
    monkeypatch.setattr(table, "_plain", lambda t: done.append(len(t)) or plain(t))
    texts = ["some words that come again and again " * 50] * 20
    ids, at = table.encode_all(*common.text_buffer(pa.array(texts)))
    assert ids[at[3] : at[4]].tobytes() == plain(texts[3]) and sum(done) < 0.02 * sum(map(len, texts))


def test_a_batch_uses_the_room_of_the_one_before():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 300, 6000)
    model = attention.Model(300)
    p = model.weights([ids], epochs=1)
    win, target, _, _ = model._windows(ids, np.array([len(ids)]))
    goal, valid, room = model.cls[np.maximum(target, 0)], target >= 0, attention.Room()
    first = model._gradient(p, win[:256], goal[:256], valid[:256], room)
    tracemalloc.start()
    again = model._gradient(p, win[:256], goal[:256], valid[:256], room)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 600_000 < 4 * 256 * model.stride * model.classes  # less than the logits alone take
    assert all((first[k] == again[k]).all() for k in first)
