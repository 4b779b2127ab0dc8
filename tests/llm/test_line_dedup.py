from veilframe.llm import line_dedup as L


def brute(rows, min_words=50):
    """First occurrences by (id, place) for unique ids."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        kept = []
        for chunk in L.chunks(text) if text else []:
            body = "\n".join(chunk)
            counted = [len(x.split()) for x in chunk]
            if (sum(n > 0 for n in counted) >= 2 or sum(counted) >= min_words) and body in seen:
                continue
            seen.add(body)
            kept += chunk
        out[i] = "\n".join(kept) if text else text
    return out


def test_chunks_rejoin_and_fall_in_step():
    lines = [f"line {i} of a passage" for i in range(60)]
    assert [x for c in L.chunks("\n".join(lines)) for x in c] == lines
    a = {tuple(c) for c in L.chunks("\n".join(["intro"] + lines))}
    b = {tuple(c) for c in L.chunks("\n".join(["another", "start"] + lines))}
    assert len(a & b) >= len(a) - 2


def test_against_brute_force(spark):
    passage = "\n".join(f"shared line {i} " + "word " * 8 for i in range(12))
    rows = [(i, f"own {i}\n{passage}\nend {i}") for i in range(30)] + [(100, None), (101, ""), (102, "\n\n"), (103, "short\nshort"), (104, "long " * 60), (105, "long " * 60)]
    rows += [(200 + i, f"single {i}\n" + "one wide line " * 20) for i in range(4)]
    df = spark.createDataFrame([(i, t, "s", 5) for i, t in rows], "doc_id long, text string, source string, n_lines_removed int")
    out = L.dedup(df)
    assert out.columns == ["doc_id", "text", "source", "n_chunks_removed", "n_lines_removed"]
    assert {r.doc_id: r.text for r in out.collect()} == brute(rows)


def test_repeated_rows_null_ids_and_empty(spark):
    text = "\n".join(f"line {i} here" for i in range(9))
    df = spark.createDataFrame([(None, text), (1, text), (1, text)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.text) for r in L.dedup(df).collect())
    tail = brute([(None, text), (1, text)])[1]
    assert got == sorted([(True, text), (False, tail), (False, tail)])
    assert L.dedup(df.limit(0)).collect() == []


def test_planted_passages_go_whole(spark):
    """Passages of 1 to 12 lines and over 50 words, each planted in two documents among lines of their own."""
    rows, planted = [], {}
    for n, (lines, words) in enumerate([(1, 60), (1, 100), (2, 30), (3, 25), (4, 20), (8, 20), (12, 5), (12, 20)] * 3):
        passage = [" ".join(f"p{n}x{i}y{k}" for k in range(words)) for i in range(lines)]
        for copy in (2 * n, 2 * n + 1):
            own = [f"own line {copy} {i} of the document" for i in range(10)]
            planted[copy] = own, passage
            rows.append((copy, "\n".join(own[:5] + passage + own[5:])))
    rows += [(900, "\n".join(["same five words once more"] * 40)), (None, "one line " * 30), (901, "one line " * 30), (902, None), (903, "")]
    got = {r.doc_id: r for r in L.dedup(spark.createDataFrame(rows, "doc_id long, text string"), passages=True).collect()}
    for i, (own, passage) in planted.items():
        assert got[i].text == "\n".join(own[:5] + passage * (i % 2 == 0) + own[5:])
        assert got[i].n_lines_removed == len(passage) * (i % 2)
    assert 10 <= len(got[900].text.split("\n")) < 40
    assert got[None].text == "one line " * 30 and (got[901].text, got[902].text, got[903].text) == ("", None, "")
