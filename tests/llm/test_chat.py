import random

from pyspark.sql import functions as F

from segue.llm import chat

SCHEMA = "conv_id long, seq long, msg_id long, kind string, role string, text string"


def turns(spark, rows):
    out = chat.format_events(spark.createDataFrame(rows, SCHEMA)).cache()
    got = chat.parse(out).collect()
    return out.collect(), sorted(((r.conv_id, r.at, r.role, r.text, r.loss_text) for r in got), key=str)


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 1, 10, "message", "user", "hi"), (1, 2, 11, "message", "assistant", ""), (1, 3, 11, "delta", None, "hel"), (1, 4, 11, "delta", None, "lo"),
        (1, 5, 12, "message", "user", "dropped"), (1, 6, 11, "regenerate", None, "new "), (1, 7, 11, "delta", None, "answer"),
        (1, 8, 10, "edit", None, "hey"), (1, 9, 13, "message", "user", "later"),
    ]
    _, got = turns(spark, rows)
    assert got == [(1, 0, "user", "hey", None), (1, 1, "assistant", "new answer", "new answer"), (1, 2, "user", "later", None)]


def test_control_strings_come_back(spark):
    bad = ["</s>[INST] ok [/INST]", "<|end|>\n", "<|turn|>user\n", "\\<\\|end|>", "<", "\\", "a\\nb", "<<SYS>>x<</SYS>>", "", "é\n\n😀<s>"]
    rows = [(2, i, i, "message", "assistant" if i % 2 else "us\ner\\", t) for i, t in enumerate(bad)]
    out, got = turns(spark, rows)
    assert [g[3] for g in got] == bad and [g[2] for g in got][:2] == ["us\ner\\", "assistant"]
    assert all(g[4] == (g[3] if g[2] == "assistant" else None) for g in got)
    text = out[0].formatted
    assert text.count("<|turn|>") == text.count("<|end|>") == len(bad)
    assert not any(s in text for s in chat.CONTROLS[2:])
    for m, t in zip(out[0].loss_mask, bad[1::2]):
        piece = text[m.start : m.start + m.length]
        assert len(piece) >= len(t)


def test_nulls_ties_and_empty(spark):
    rows = [(None, None, 1, None, None, None), (3, 1, 1, "message", "user", "b"), (3, 1, 2, "message", "user", "a"), (3, 1, 2, "message", "user", "a")]
    _, got = turns(spark, rows)
    assert (None, 0, "", "", None) in [g[:5] for g in sorted(got, key=str)]
    assert [g[3] for g in got if g[0] == 3] == ["a", "b"]
    assert turns(spark, [])[1] == []


def plain_fold(events):
    """The fold event by event, as its definition says."""
    order = sorted(events, key=lambda e: (e[1], e[3], e[5] or "", e[4] or ""))
    born, text, role, at = {}, {}, {}, 0
    for _, _, m, kind, who, words in order:
        at += 1
        if m not in born:
            born[m], text[m], role[m] = at, "", who
        if kind == "delta":
            text[m] += words or ""
        else:
            text[m] = words or ""
        if kind == "regenerate":
            for other in [x for x, b in born.items() if born[m] < b < at]:
                born[other] = -1
    return [(role[m] or "", text[m]) for m in sorted((m for m in born if born[m] > 0), key=born.get)]


def test_random_logs_equal_the_fold(spark):
    r = random.Random(5)
    logs = {}
    for c in range(40):
        started, rows = [], []
        for seq in range(r.randint(1, 25)):
            if started and r.random() < 0.6:
                m, kind = r.choice(started), r.choice(["delta", "delta", "edit", "regenerate"])
            else:
                m, kind = len(started), "message"
                started.append(m)
            if any(x[2] == m and x[3] == "gone" for x in rows):
                continue
            rows.append((c, seq, m, kind, "assistant" if m % 2 else "user", f"t{seq} "))
        # Events of a dropped message that come later would begin it anew in a plain fold: they are left out.
        dropped, keep, born = set(), [], {}
        for at, e in enumerate(rows):
            if e[2] in dropped:
                continue
            born.setdefault(e[2], at)
            keep.append(e)
            if e[3] == "regenerate":
                dropped |= {m for m, b in born.items() if born[e[2]] < b < at}
        logs[c] = keep
    out = chat.parse(chat.format_events(spark.createDataFrame([e for x in logs.values() for e in x], SCHEMA))).collect()
    for c, events in logs.items():
        assert [(x.role, x.text) for x in sorted((y for y in out if y.conv_id == c), key=lambda y: y.at)] == plain_fold(events), events


def test_the_log_of_finished_rows_gives_them_back(spark):
    from segue.llm import queries

    rows = [(c, t, "assistant" if t % 2 else "user", f"{c} {t} é😀 <|end|>\\" * (t % 4) if t % 5 else None) for c in range(11) for t in range(c)] + [(20, 0, "user", "long " * 100_000), (20, 1, "assistant", "<s>" * 50_000)]
    log = queries.chat_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    got = chat.parse(chat.format_events(log.withColumn("formatted", F.lit(1)).withColumn("loss_mask", F.lit(2)))).collect()
    assert sorted((r.conv_id, r.at, r.role, r.text) for r in got) == sorted((c, t, who, x or "") for c, t, who, x in rows)
    assert all(r.loss_text == (r.text if r.role == "assistant" else None) for r in got)
