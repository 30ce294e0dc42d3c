"""Packing and chat windows on very long runs and control strings; budgets of windows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from warraq.llm import chat_format, packing

LONG = {1: " " * 2_000_000, 2: "\n" * 2_000_000, 3: "\t" * 2_000_000, 4: "a" * 2_000_000, 5: "7" * 2_000_000, 6: "x " + " " * 1_200_000 + "y" + "\r\n" * 300_000 + "z"}
LONG |= {7: "<|endoftext|>", 8: "a<|endoftext|> b<|endoftext|><|endoftext|", 9: "word " * 300_000 + "<|endoftext|>" + " " * 50_000}


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_of_long_runs_and_control_strings(spark, plain):
    df = spark.createDataFrame(list(LONG.items()), "doc_id long, text string").repartition(4)
    out = packing.pack(df).toPandas()
    for i, text in LONG.items():
        ids = np.array([*plain(text), 2], dtype="<u4")
        own = out[out.doc_id == i].sort_values("piece")
        cuts = np.concatenate([own.start.values, [len(ids)]])
        assert own.length.sum() == len(ids)
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def test_windows_of_long_runs(spark):
    turns = [(i, k, role, text) for i, text in LONG.items() for k, role in ((1, "user"), (2, "assistant"))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat_format.read_back(chat_format.format_windows(df), in_order=True).collect()}
    assert got == {i: (2, len(t)) for i, t in LONG.items()}


@pytest.mark.parametrize("budget,history", [(64, 2), (1024, 3), (1024, 0)])
def test_no_window_is_over_the_budget(budget, history):
    rng = random.Random(budget + history)
    for number in range(300):
        lead = [("system", "s" * rng.randrange(1, budget)) for _ in range(rng.randrange(3))]
        turns = lead + [(rng.choice(["user", "assistant", "system"]), "x" * rng.choice([3, budget // 4, budget // 2, budget - 20, 2 * budget])) for _ in range(rng.randrange(1, 20))]
        c = chat_format._Conversation(number, len, budget, history)
        windows = [w for role, text in turns for w in c.add(role, text)] + [c.flush()]
        sizes = [len(chat_format.write_turn(role, text)[0]) for role, text in turns]
        kept, total = 0, 0  # the leading system turn, and those that follow it in three quarters of the budget
        while kept < len(turns) and turns[kept][0] == "system" and total + sizes[kept] <= (0.75 * budget if kept else budget):
            total, kept = total + sizes[kept], kept + 1
        at = kept
        for w in windows:
            assert len(w["text"]) == w["tokens"]
            new, at = sizes[at : at + w["n_turns"]], at + w["n_turns"]
            if len(new) == 1 and new[0] > budget:
                assert w["n_system"] == kept and w["n_repeat"] == 0
                continue
            assert w["tokens"] <= budget
            if w["n_system"] != kept:  # only where the first new turn does not fit beside them
                assert w["n_system"] == 0 and total + new[0] > budget
        assert at == len(turns)


def test_the_system_turn_stays_whatever_its_share():
    c = chat_format._Conversation(1, len, 1024, 2)
    turns = [("system", "s" * 680)] + [("user", "x" * n) for n in (500, 600, 100, 150, 900, 20)]
    windows = [w for role, text in turns for w in c.add(role, text)] + [c.flush()]
    assert [(w["n_system"], w["n_turns"]) for w in windows] == [(1, 0), (0, 1), (0, 1), (1, 2), (0, 1), (1, 1)]
    assert all(w["tokens"] <= 1024 for w in windows)
