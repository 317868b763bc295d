import hashlib
import random

from ledgerlake.llm import chat as c


def rows():
    rng = random.Random(4)
    bits = ["<|im_start|>", "<|im_end|>", "</s>", "[INST]", "\\", "\\\\", "<", "|", "text ", "é中😀", "\n", "<|im_", "sep|>"]
    found = [(k, t, "assistant" if t % 2 else "user", "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for k in range(30) for t in range(rng.randrange(1, 6))]
    return found + [(None, 0, "user", "no id"), (50, 0, None, None), (51, 1, "assistant", "b"), (51, 1, "assistant", "a"), (51, None, "system", "first"), (52, 0, "assistant", "x" * 30000)]


def expected():
    by = {}
    for conv, turn, role, text in rows():
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        chars = sum(len(c.escape(r)) + len(c.escape(t)) + len(c.START + c.SEPARATOR + c.END) for *_, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    return out


def frame(spark):
    return spark.createDataFrame([(*r, "x") for r in rows()], "conv_id long, turn long, role string, text string, ids string").repartition(3)


def test_escape():
    for *_, text in rows():
        e = c.escape(text or "")
        assert c.unescape(e) == (text or "") and not any(x in e for x in c.CONTROL)


def test_round_trip(spark):
    found = c.read_back(c.format_conversations(frame(spark))).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == expected() and len(found) == len(expected())
    assert c.read_back(c.format_conversations(frame(spark).limit(0))).count() == 0


def test_places_and_mask(spark):
    t = c.tokens(None)
    turns = c.format_conversations(frame(spark)).where("conv_id = 51").orderBy("position").collect()
    assert [r.position for r in turns] == [0, 1, 2]
    ids = [i for r in turns for i in r.ids]
    assert [r.first_token for r in turns] == [0, len(turns[0].ids), len(turns[0].ids) + len(turns[1].ids)]
    masked = ["".join(t.decode(__import__("numpy").array(ids[r.loss_start : r.loss_end]))) if r.loss_end > r.loss_start else "" for r in turns]
    assert masked == ["", "a", "b"] and ids.count(t.start) == ids.count(t.end) == ids.count(t.separator) == 3


def test_long_runs():
    t = c.tokens(None)
    for text in (" " * 1_000_000, "a" * 1_000_000 + " " * 1_000_000 + "b", "\n \t" * 400_000, "ab" * 500_000, "!?" * 500_000):
        assert t.decode(__import__("numpy").array(t.encode(text))) == text
    for n in (999, 1000, 1001, 1500):
        for text in (" " * n, "x" + " " * n + "y", "x" + "\n" * n, " " * n + "1\n" + " " * n + "."):
            assert t.encode(text) == t.encoding.encode_ordinary(text)
