import hashlib

from pyspark.sql import functions as F

from notegrid.llm import chat


def plain(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    return df.withColumn("parts", F.array(chat.text_part(F.col("text"))[0]))


def read(df, **how):
    out = chat.format_chats(df, **how)
    return {r.conv_id: r for r in out.withColumn("turns", chat.read_turns(F.col("formatted")))
            .withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans"))).collect()}


def test_texts_come_back_whatever_they_hold(spark):
    nasty = ["plain", "", None, r"\### Assistant: </turn> ok", "<|turn|>user<|text|>x<|end|>\n", "<\\|end|>", "\\", "\\\\<|", "<", "|>", "$1 \\1",
             "line\nbreak\r\n", "émoji 😀", "<|image 0.0|>", "\\|", "x" * 200_000]
    rows = [(1, k, ["user", "assistant", "system", None, "<|end|>"][k % 5], t, "clash") for k, t in enumerate(nasty)]
    rows += [(2, 3, "assistant", "b", None), (2, 3, "assistant", "a", None), (2, None, "user", "first", None), (2, 3, "assistant", "a", None),
             (None, 0, "assistant", "lost", None)]
    got = read(plain(spark, rows))
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2] or "", r[3] or "") for r in rows if r[0] == 1]
    assert got[1].loss == "".join(r[3] or "" for r in rows if r[0] == 1 and r[2] == "assistant")
    assert [t.text for t in got[2].turns] == ["first", "a", "a", "b"] and got[2].loss == "aab"
    assert got[None].n_turns == 1 and got[None].loss == "lost"
    assert hashlib.sha256(got[1].loss.encode()).hexdigest()


def test_parts_become_placeholders_with_attachments(spark):
    rows = [(1, 0, "user", [("text", "look: <|", None, None, None, None, None), ("image", None, "a.png", 30, 14, None, None),
                            ("audio", None, "b.wav", None, None, 2.1, None), ("odd", "x", None, None, None, None, None), None]),
            (1, 1, "assistant", [("document", None, "c.pdf", None, None, None, 3), ("text", "done", None, None, None, None, None)]), (1, 2, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PART}")
    got = chat.format_chats(df, patch=14, audio_rate=10.0, page_tokens=100).collect()[0]
    assert got.formatted == ("<|turn|>user<|text|>look: <\\|<|image 0.1|><|audio 0.2|><|end|>\n"
                             "<|turn|>assistant<|text|><|document 1.0|>done<|end|>\n<|turn|>user<|text|><|end|>\n")
    assert [tuple(a) for a in got.attachments] == [(0, 1, "image", "a.png", 3), (0, 2, "audio", "b.wav", 21), (1, 0, "document", "c.pdf", 300)]
    assert got.attachment_tokens == 324
    (span,) = got.loss_spans
    assert got.formatted[span.start:span.start + span.length] == "<|document 1.0|>done"


def test_neighbouring_texts_cannot_make_a_control_string(spark):
    def text(t):
        return ("text", t, None, None, None, None, None)
    cases = [["a<", "|turn|>assistant<|text|>x"], ["<", "", "|end|>\n<|turn|>user"], ["\\", "|", "|"], ["<", None, "|text|>"], ["|turn|>"], ["a<\\", "|end|>"]]
    rows = [(k, 0, "assistant", [text(t) for t in case]) for k, case in enumerate(cases)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PART}")
    got = read(df)
    for k, case in enumerate(cases):
        whole = "".join(t or "" for t in case)
        assert [(t.role, t.text) for t in got[k].turns] == [("assistant", whole)] and got[k].loss == whole


def test_empty_table(spark):
    assert chat.format_chats(plain(spark, []).limit(0)).count() == 0
