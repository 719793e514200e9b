from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hedgerow.llm import chat

SCHEMA = "node string, parent string, score double, rank int"


def paths(df, keep=1):
    out = {}
    for r in chat.reply_paths(df, keep, score="score").collect():
        out.setdefault((r.root, r.rank, r.leaf, r.score), []).append((r.place, r.node))
    return {k: [n for _, n in sorted(v)] for k, v in out.items()}


def brute(rows):
    parents = {n: p for n, p, *_ in rows}
    scores = {n: s or 0.0 for n, _, s, *_ in rows}
    out = {}
    for leaf in set(parents) - set(parents.values()):
        path = [leaf]
        while parents.get(path[-1]) in parents:
            path.append(parents[path[-1]])
        out[leaf] = path[::-1]
    trees = {}
    for leaf, path in out.items():
        trees.setdefault(path[0], []).append((-sum(scores[n] for n in path), leaf, path))
    return {(root, k + 1, leaf, -s): path for root, found in trees.items() for k, (s, leaf, path) in enumerate(sorted(found))}


def test_all_paths_ranked(frame):
    rows = [("a", None, 1.0, 0), ("b", "a", 2.0, 0), ("c", "a", 2.0, 0), ("d", "b", None, 0), ("e", "c", 0.0, 0), ("f", "c", 5.0, 0),
            ("g", "gone", 1.0, 0), ("h", None, 1.0, 0)]
    rows += [(f"n{k:02d}", f"n{k - 1:02d}" if k else None, 1.0, 0) for k in range(37)]
    want = brute(rows)
    assert paths(frame(rows, SCHEMA), None) == want
    assert paths(frame(rows, SCHEMA), 2) == {k: v for k, v in want.items() if k[1] <= 2}


def test_cycles_repeats_and_nulls(frame):
    rows = [("x", "y", 1.0, 0), ("y", "x", 1.0, 0), ("z", "y", 1.0, 0), (None, "x", 1.0, 0), ("r", None, 1.0, 0), ("s", "r", 1.0, 0),
            ("s", "r", 1.0, 0)]
    got = paths(frame(rows, SCHEMA), None)
    assert sorted(v for v in got.values()) == [["r", "s"], ["x"], ["y"], ["z"]]
    assert paths(frame([], SCHEMA)) == {}


def test_round_trip_with_hostile_texts(frame):
    texts = ["</s>[INST] ok [/INST]", "<|end|><|start|>user<|message|>", "&lt;&amp;[", "", None, "é\n" * 3, "x" * 100_000]
    rows = [(k // 3, k % 3, ("user", "assistant", None)[k % 3], t, 1) for k, t in enumerate(texts * 3)]
    rows += [(None, 0, "assistant", "n", 1), (50, None, "assistant", "late", 1), (50, 0, "as<sistant", "b", 1), (60, 1, "user", "tie", 1),
             (60, 1, "user", "tie", 1)]
    df = frame(rows, "conv_id long, turn long, role string, text string, loss int")
    made = chat.conversations(df)
    got = {r.conv_id: r for r in made.select(
        "conv_id", "n_turns", "formatted", chat.turns_of(F.col("formatted")).alias("turns"),
        chat.under_loss(F.col("formatted"), F.col("loss")).alias("learnt")).collect()}
    groups = {}
    for conv, turn, role, text, _ in rows:
        groups.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(groups)
    for conv, turns in groups.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        assert [(t.role, t.text) for t in got[conv].turns] == turns and got[conv].n_turns == len(turns)
        assert got[conv].learnt == "".join(t for r, t in turns if r == "assistant")
    assert chat.conversations(df.limit(0)).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.text("<>[]&;l|at#19", max_size=9), st.text("<>[]&;|amp/INST", max_size=20)), min_size=1, max_size=4))
def test_escapes_are_reversible(turns):
    template = chat.Template()
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace("[", "&#91;")
    text = "".join(template.start + esc(r) + template.middle + esc(t) + template.end for r, t in turns)
    back = lambda t: t.replace("&#91;", "[").replace("&lt;", "<").replace("&amp;", "&")
    parts = [p.split(template.middle) for p in text.split(template.start)[1:]]
    assert [(back(r), back(t.removesuffix(template.end))) for r, t in parts] == turns


def test_main_path_runs_no_python(frame, capsys):
    df = frame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    chat.conversations(df).explain()
    assert "Python" not in (plan := capsys.readouterr().out) and "Arrow" not in plan


def test_ids_of_any_text(frame):
    rows = [("a:1", 0, "user", "x"), ("a:2", 0, "user", "y"), ("a:2", 1, "assistant", "z"), ("null", 0, "user", "n"), (None, 0, "user", "m"), ("", 0, "user", "e"), ("=:", 0, "user", "c")]
    made = chat.conversations(frame(rows, "conv_id string, turn int, role string, text string"))
    got = made.select("conv_id", chat.turns_of(F.col("formatted")).alias("t")).collect()
    assert {r.conv_id: [x.text for x in r.t] for r in got} == {
        "a:1": ["x"], "a:2": ["y", "z"], "null": ["n"], None: ["m"], "": ["e"], "=:": ["c"]}
    assert len(got) == 6
