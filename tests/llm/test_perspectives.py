from tapelens.llm import perspectives


def brute(rows, block_turns):
    rows = sorted({(c, t, r or "", r is None, x or "") for c, t, r, x in rows if c is not None and t is not None},
                  key=lambda r: (r[0], r[1], not r[3], r[2], r[4]))
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        for speaker in {r[2] for r in own if not r[3] and r[2] != "system"}:
            for block in {r[1] // block_turns for r in own}:
                text, spans = "", []
                for _, turn, role, missing, body in own:
                    if turn // block_turns != block:
                        continue
                    mine = not missing and role == speaker
                    if mine:
                        text += "<|assistant|>\n"
                    elif role == "system":
                        text += "<|system|>\n"
                    else:
                        text += f"<|user|>name={'unknown' if missing else role}\n"
                    start = len(text)
                    text += body + "<|end|>\n"
                    if mine:
                        spans.append(f"{start}:{len(text)}")
                out[conv, speaker, block] = (text, ",".join(spans))
    return out


def test_every_participant_gets_a_view(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hé"), (1, 2, "bob", "Hi 😀"), (1, 3, "cy", None),
            (1, 4, None, "?"), (1, 5, "ann", "Bye"), (1, 5, "ann", "Bye"), (1, 5, "ann", "Later"), (1, 5, "bob", "x"),
            (2, 0, "system", "only"), (None, 0, "ann", "lost"), (3, None, "ann", "lost"),
            *[(4, i, "ab"[i % 2], f"t{i}") for i in range(23)]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 as block", "'x' as speaker")
    got = {(r.conv_id, r.speaker, r.block): (r.text, r.mask) for r in perspectives.rotate(turns, 8).collect()}
    assert got == brute(rows, 8)
    assert {k[2] for k in got if k[0] == 4} == {0, 1, 2}
    assert perspectives.rotate(turns.limit(0)).collect() == []
