"""Graphs of parsed texts, voting and classifiers."""

import ast

import pandas as pd
from pyspark.sql import functions as F

from vulnlake.operators import evaluation, graph, models, votes

TEXT = "x = 1\nif x > 0:\n    y = x\nelse:\n    y = f(x)\nwhile y:\n    y = y - 1\n"


def nodes(spark, text=TEXT):
    return graph.parse_nodes(spark.createDataFrame([(7, text), (8, "def broken(:")], "file_id long, text string"))


def test_nodes_follow_the_tree(spark):
    got = nodes(spark).orderBy("node_id").collect()
    assert len(got) == sum(1 for _ in ast.walk(ast.parse(TEXT)))
    assert {r.file_id for r in got} == {7}
    by_id = {r.node_id: r for r in got}
    assert got[0].parent_id is None and got[0].depth == 0
    assert all(by_id[r.parent_id].node_type == r.parent_type and by_id[r.parent_id].depth + 1 == r.depth for r in got[1:])
    assert all(r.num_children == sum(1 for o in got if o.parent_id == r.node_id) for r in got)


def test_edges(spark):
    n = nodes(spark).cache()
    rows = {r.node_id: r for r in n.collect()}
    assert graph.tree_edges(n).count() == 2 * (len(rows) - 1)
    assert graph.sequence_edges(n).count() == len(rows) - 1
    control = {(r.source, r.target) for r in graph.control_edges(n).collect()}
    branch = next(i for i, r in rows.items() if r.node_type == "If")
    test = next(i for i, r in rows.items() if r.parent_id == branch and r.field == "test")
    body, other = (min(i for i, r in rows.items() if r.parent_id == branch and r.field == f) for f in ("body", "orelse"))
    loop = next(i for i, r in rows.items() if r.node_type == "While")
    inner = next(i for i, r in rows.items() if r.parent_id == loop and r.field == "body")
    call = next(i for i, r in rows.items() if r.node_type == "Call")
    callee = next(i for i, r in rows.items() if r.parent_id == call and r.field == "func")
    assert {(0, branch), (branch, test), (test, body), (test, other), (0, loop), (loop, inner), (inner, loop), (call, callee),
            (rows[call].parent_id, call)} == control


def test_dataflow(spark):
    n = nodes(spark).cache()
    rows = n.collect()
    names = [(r.node_id, r.value, r.is_definition) for r in rows if r.node_type in ("Name", "arg")]
    every = {(d, u) for d, name, is_def in names if is_def for u, other, also in names if not also and other == name and d < u}
    last = {(max(d for d, m, is_def in names if is_def and m == name and d < u), u) for u, name, is_def in names
            if not is_def and any(is_d and m == name and d < u for d, m, is_d in names)}
    assert {(r.source, r.target) for r in graph.dataflow_edges(n).collect()} == every
    assert {(r.source, r.target) for r in graph.dataflow_edges(n, True).collect()} == last


def test_features_tokens_and_means(spark):
    n = nodes(spark).cache()
    one = graph.node_features(n).filter("category = 'literal'").first()
    assert (one.is_literal, one.has_digit, one.is_other) == (1.0, 1.0, 0.0)
    tokens = graph.leaf_tokens(n).first().tokens
    assert tokens[:4] == ["Module", "Assign", "Name", "Store"] or tokens[0] == "Module"
    edges = graph.tree_edges(n).unionByName(graph.sequence_edges(n))
    row = graph.graph_stats(n, edges).first()
    assert row.samples == 1 and row.avg_nodes == n.count() and abs(row.ast_share - 2 / 3) < 1e-9


def predictions(spark, ps):
    return spark.createDataFrame([(1, i, p, w) for i, (p, w) in enumerate(ps)], "sample_id int, model_no int, probability double, weight double")


def test_votes(spark):
    p = predictions(spark, [(0.9, 1.0), (0.4, 3.0), (0.6, 1.0)])
    got = {s: votes.combine(p, s).first() for s in votes.STRATEGIES}
    assert got["majority"].is_vulnerable and abs(got["majority"].confidence - 1 / 3) < 1e-9
    assert abs(got["weighted"].confidence - abs(0.54 - 0.5) * 2) < 1e-9 and abs(got["weighted"].agreement - 0.6) < 1e-9
    assert got["average"].is_vulnerable and abs(got["average"].agreement - 2 / 3) < 1e-9
    assert got["max_confidence"].confidence == 0.8
    assert got["stacking"][1:4] == got["weighted"][1:4] and got["stacking"].strategy == "stacking"
    tie = votes.combine(predictions(spark, [(0.25, 1.0), (0.75, 1.0)]), "max_confidence").first()
    assert not tie.is_vulnerable


def test_temperature(spark):
    frame = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.2)], "label int, probability double")
    losses = {r.temperature: r.loss for r in evaluation.temperature_losses(frame).collect()}
    best = evaluation.best_temperature(frame).first()
    assert len(losses) == 25 and best.loss == min(losses.values()) and losses[best.temperature] == best.loss


def test_line_risk(spark):
    lines = spark.createDataFrame([(1, 1, "a" * 120), (1, 2, "b")], "s int, line_no int, line string")
    tokens = spark.createDataFrame([(1, 1, f"t{i}", i, 0.4 + i / 10) for i in range(7)], "s int, line_no int, token string, position int, importance double")
    got = {r.line_no: r for r in evaluation.line_risk(lines, tokens, "s").collect()}
    assert got[1].risk_score == 0.91 and got[1].contributing_tokens == ["t6", "t5", "t4", "t3", "t2"] and len(got[1].code_snippet) == 100
    assert got[2].risk_score == 0.0 and got[2].contributing_tokens == []


def test_classifiers_learn_the_flag(spark):
    frame = spark.createDataFrame([(i, "eval(x)" if i % 3 == 0 else f"y = {i}", int(i % 3 == 0)) for i in range(60)], "id int, code string, label int")
    samples = models.with_features(frame).withColumn("weight", F.when(F.col("label") == 1, 1.5).otherwise(0.75))
    for model in (models.train_network(samples, 40), models.train_weighted(samples, 40)):
        scored = models.score(model, samples)
        assert evaluation.binary_metrics(scored).first().accuracy == 1.0
        assert {"vulnerable", "confidence", "p_safe", "label_text"} <= set(scored.columns)


def test_outside_model(spark):
    frame = spark.createDataFrame([("aaaa",), ("a",)], "code string")

    def load():
        return lambda batch: pd.Series(batch.str.len() / 5)

    assert sorted((r.code, r.prediction) for r in models.score_with(frame, load).collect()) == [("a", 0), ("aaaa", 1)]


def test_the_register_is_sent_to_the_predictions(spark, tmp_path):
    """However small the predictions look: only the register has a known number of rows."""
    predictions(spark, [(0.9, 1.0), (0.4, 3.0)]).select(F.lit("net").alias("model"), "probability").write.parquet(str(tmp_path / "p"))
    register = votes.model_register(spark, [("net", "mlp", 1.5, 0.9), ("tree", "gbt", 1.0, None)])
    assert [tuple(r) for r in register.collect()] == [(0, "net", "mlp", 1.5, 0.9), (1, "tree", "gbt", 1.0, None)]
    joined = votes.with_weights(spark.read.parquet(str(tmp_path / "p")), register)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and "ExistingRDD" not in plan
    assert sorted((r.model, r.model_no, r.weight, r.probability) for r in joined.collect()) == [("net", 0, 1.5, 0.4), ("net", 0, 1.5, 0.9)]
    assert votes.model_register(spark, []).count() == 0


def test_nodes_leave_a_task_in_small_batches(spark):
    """However many texts come in one batch, a task never holds all their nodes."""
    import pyarrow as pa

    texts = [TEXT] * 2000 + ["def broken(:", "", None, "z = " + "+".join(map(str, range(90)))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["file_id", "text"])
    parts = list(graph._node_batches([batch], None))
    assert len(parts) > 5 and max(p.num_rows for p in parts) <= graph.BATCH_NODES
    assert sum(p.num_rows for p in parts) == sum(sum(1 for _ in ast.walk(ast.parse(t or ""))) for t in texts if t != "def broken(:")


def test_edges_of_several_kinds_parse_texts_once(spark):
    from vulnlake.plans import catalog

    for name in ("g4_dataflow_edges", "a35_graph_stats"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "nodes-" in plan


def test_equal_samples_are_one_row_of_the_training(spark):
    """A pass over the network costs what distinct samples cost; their number counts in the loss."""
    import numpy as np

    frame = spark.createDataFrame([(i, "eval(x)" if i % 3 == 0 else "y = 1", int(i % 3 == 0)) for i in range(90)], "id int, code string, label int")
    samples = models.with_features(frame)
    assert sorted(r.n for r in models.merged_samples(samples).collect()) == [30, 60]
    rows = [(r.features.toArray(), r.label, 1) for r in samples.collect()]
    merged = [(r.x, r.label, r.n) for r in models.merged_samples(samples).collect()]
    network = models.train_network(samples, 5).stages[0]
    weights = network.weights.toArray()
    all_rows, few_rows = (models.loss_and_gradient(weights, models._arrays(part)) for part in (rows, merged))
    assert np.allclose(all_rows, few_rows)
    # Spark's network gives the same probabilities, and the gradient is that of the loss.
    shares = np.array([network.predictProbability(r.features)[r.label] for r in samples.collect()])
    assert np.isclose(-np.log(shares).sum(), all_rows[0])
    for at in (3, 6600, len(weights) - 1):
        moved = [weights + step * (np.arange(len(weights)) == at) for step in (1e-5, -1e-5)]
        up, down = (models.loss_and_gradient(w, models._arrays(merged))[0] for w in moved)
        assert np.isclose((up - down) / 2e-5, few_rows[at + 1], atol=1e-5)
    again = models.train_network(samples.unionByName(samples), 5).stages[0]
    assert np.allclose(again.weights.toArray(), weights, atol=1e-6)


def test_edges_and_features_have_only_their_columns_sent(spark):
    from vulnlake.plans import catalog

    for name, columns, unused in (("g5_control_edges", graph.CONTROL_COLUMNS, ("end_col", "value")), ("g6_g7_node_features", graph.FEATURE_COLUMNS, ("end_col", "field_no"))):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and not any(f"{column}#" in plan for column in unused)
    texts = spark.createDataFrame([(7, TEXT), (8, "def broken(:")], "file_id long, text string")
    for columns, step in ((graph.CONTROL_COLUMNS, graph.control_edges), (graph.FEATURE_COLUMNS, graph.node_features)):
        few, every = (step(graph.parse_nodes(texts, columns=c)) for c in (columns, tuple(graph.NODE_TYPES)))
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, every.collect()))


def test_only_numbers_of_lines_are_shuffled(spark):
    """The lines of a text are made after the shuffle that brings their numbers together."""
    from vulnlake.plans import tables

    plan = tables.code_files(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange"):]
    assert "l_suppkey" in below and "element_at" not in below


def named(spark, text, **options):
    """Edges of the names of a text as (name, line of the definition, line of the use), of all definitions and the last one."""
    n = graph.parse_nodes(spark.createDataFrame([(1, text)], "file_id long, text string"), columns=(*graph.DATAFLOW_COLUMNS, "start_line"), **options).cache()
    at = {r.node_id: (r.value, r.start_line) for r in n.collect()}
    return [sorted((at[r.source][0], at[r.source][1], at[r.target][1]) for r in graph.dataflow_edges(n, last).collect()) for last in (False, True)]


def test_names_of_texts_that_do_not_parse(spark):
    """A line that does not parse hid all names of its text."""
    text = "x = 1\nconst v = x\nif (v == 1) { run(v.x) }\nx += v\nprint(x)\n"
    every, last = named(spark, text, recover=True)
    assert every == [("v", 2, 3), ("v", 2, 3), ("v", 2, 4), ("x", 1, 2), ("x", 1, 4), ("x", 1, 5), ("x", 4, 5)]
    assert last == [e for e in every if e != ("x", 1, 5)]
    assert named(spark, text) == [[], []]
    blocks = "def f(a):\n    b = a\n    c = = b\n    return b\ntry:\n    d = f(\n        b)\nexcept E as e:\n    $ e\nelse:\n    g = d\n"
    assert named(spark, blocks, recover=True)[1] == [("a", 1, 2), ("b", 2, 3), ("b", 2, 4), ("b", 2, 7), ("d", 6, 11)]
    script = "let a = 1; /* a\n a */ // a\nlet s = `a ${a}\n a`;\nfunction f(p) {\n  'a';\n  return s + a;\n}\n"
    assert named(spark, script, recover=True)[0] == [("a", 1, 3), ("a", 1, 7), ("s", 3, 7)]


def test_recovered_texts_keep_what_parses():
    """A text that parses has the same nodes; one more line that does not leaves those of the others as they are."""
    texts = [TEXT, "", "@d\ndef f(a, *b: int):\n    '''t\n t'''\n    return [\na, b]\n", "class A:\n\tx = 1\n\n\tdef m(self): pass\nif A: y = A\nelse: y = 2\n", "é = 'ü'; z = é\n"]
    for text in texts:
        rows = list(graph._nodes_of(1, text, None))
        assert rows and list(graph._nodes_of(1, text, None, True)) == rows
        more = list(graph._nodes_of(1, text + "?\n", None, True))
        assert list(graph._nodes_of(1, text + "?\n", None)) == [] and more[1:] == rows[1:]
    for odd in ("\0", "(" * 5000, "\ud800 = 1", "if 1:\n" + "".join(" " * i + "if x:\n" for i in range(1, 300)), "'" * 7, "`${`", "a = 1\r\nb = ? a\rc", "x = \\"):
        assert len(list(graph._nodes_of(1, odd, None, True))) >= 1


def test_dataflow_edges_of_all_texts(spark, tmp_path, monkeypatch):
    """The query reads the texts that do not parse, too."""
    from vulnlake.plans import catalog, tables

    place = tables.CODE_LINES.index
    numbers = [place("const v@@ = require(\"x\")"), place("cfg = yaml.load(stream_@@)"), place("n = random.randint(1, @@)"), place("cfg = yaml.load(stream_@@)")]
    n = len(tables.CODE_LINES)
    parts = [next(p for p in range(n) if (p * 7 + 3) % n == k) for k in numbers]
    spark.createDataFrame([(5, i, p, 3, 1.0) for i, p in enumerate(parts)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    seen, edges = [], graph.dataflow_edges
    monkeypatch.setattr(graph, "dataflow_edges", lambda nodes, last=False: seen.append(nodes) or edges(nodes, last))
    catalog.QUERIES["g4_dataflow_edges"](spark, str(tmp_path))
    assert sorted(r["value"] for r in seen[0].filter("is_definition").collect()) == ["cfg", "cfg", "n", "v3"]
