import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from colloquy import catalog, config
from colloquy.functions import answers as A
from colloquy.operators import datasets as D
from colloquy.plans import deliberation as P
from colloquy.plans import evaluation as E
from colloquy.plans import generation as G
from colloquy.plans import prompts, training
from colloquy.sources import datasets as S
from colloquy.sources import stores
from colloquy.streaming import metrics

SF = "/root/testdata/sf0.001"


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


YES_NO = [("My answer: yes, gladly", "YES"), ("FINAL ANSWER no", "NO"), ("I believe the answer is yes", "YES"), ("We saw rain and nothing else", None), ("At first yes, later no, and then silence", "NO"), ("answer:  Nobody knows", "NO"), ("", None), (None, None)]


@pytest.mark.parametrize(("text", "wanted"), YES_NO)
def test_yes_no(spark, text, wanted):
    assert one(spark, text, A.extract_yes_no) == wanted


CHOICE = [("Surely (d) fits", "D"), ("final answer b", "B"), ("Between them I take C", "C"), ("the correct answer is ( a )", "A"), ("Pick (F) instead", None), ("an optional bonus", "A"), ("answer: Berlin", "B"), ("choice D over the rest", "D")]


@pytest.mark.parametrize(("text", "wanted"), CHOICE)
def test_choice(spark, text, wanted):
    assert one(spark, text, A.extract_choice) == wanted


@pytest.mark.parametrize(("text", "wanted"), [("Yes", "Y"), ("(A)", "A"), ("B.", "B"), (None, ""), ("  YES  ", "Y")])
def test_normalize(spark, text, wanted):
    assert one(spark, text, A.normalize_answer) == wanted


def test_wrong_answer_of_many_choices(spark):
    choices = [[f"C{i}" for i in range(n + 1)] for n in range(1, 301)]
    rows = spark.createDataFrame([(len(c) - 1, c) for c in choices], "n int, choices array<string>").select("n", A.wrong_answer(F.lit("c0"), F.col("choices")).alias("wrong"))
    assert {r.n: r.wrong for r in rows.collect()} == {len(c) - 1: random.Random(42).choice(c[1:]) for c in choices}


def test_wilson(spark):
    assert abs(spark.range(1).select(P.wilson(F.lit(2 / 3), F.lit(3))).first()[0] - 0.365424) < 1e-6


def test_early_stop():
    assert P.early_stop([0.5, 0.5, 0.4, 0.9], patience=2) == 3


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations", "orders", "part", "events", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours = catalog.queries()[name](spark, SF).toArrow()
    theirs = con.sql(catalog.oracle_sql()[name]).to_arrow_table().select(ours.column_names)
    rows = lambda x: sorted(str(tuple(r.values())) for r in x.to_pylist())
    assert rows(ours) == rows(theirs)


def test_all_queries_have_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_rollout_reward_brute_force(spark):
    """Each state of three rounds with the actor's earlier responses before it; no SQL."""
    answers = dict(zip(G.CANNED, ("Y", "N", "N", "N", "", "Y", ""), strict=True))

    def say(role, sim, prompt):
        return G.CANNED[int(hashlib.md5(f"{role}|42|{sim}|{prompt}".encode()).hexdigest()[:6], 16) % len(G.CANNED)]

    def ask(r, said):
        others = "Others:" + "".join(f"\nPerson {i} said: {x}" for i, x in enumerate(said, 1)) + "\n" if said else ""
        return f"Question: {r.question}\nPassage: {r.passage}\n{others}Reply yes or no."

    wanted = {}
    for r in catalog.standardize_yes_no(spark, SF).collect():
        both, actor = [], []
        for t in range(3):
            a = say("actor", 0, ask(r, both))
            c = say("critic", 0, f"Question: {r.question}\nPassage: {r.passage}\nReply under review: {a}\nGive feedback.")
            right = [answers[say("actor", sim, ask(r, [*actor, a, c]))] == r.answer[0].upper() for sim in range(1, 6)]
            wanted[r.sample_id, t] = sum(right) / 5
            both, actor = [*both, a, c], [*actor, a]
    got = catalog.rollout_reward(spark, SF).collect()
    assert len(got) == len(wanted) and {(r.sample_id, r["round"]): r.reward for r in got} == wanted


def test_simulation_needs_history(spark):
    with pytest.raises(ValueError):
        P.simulate(spark.createDataFrame([("q", "yes", "a", "c")], "question string, answer string, actor_response string, critic_response string"), 2)


SAMPLES = "sample_id long, question string, passage string, answer string"


def test_model_responder_asks_once_and_isolates(spark, tmp_path):
    """Each prompt is answered once; a failing prompt spoils its own sample alone; a task loads and closes its model."""
    log = str(tmp_path)

    class Model:
        def __init__(self, role):
            self.role = role

        def generate(self, prompts, sampling):
            if any("broken" in x for x in prompts):
                raise RuntimeError("cannot say")
            for x in prompts:
                with open(f"{log}/asked-{hashlib.md5((self.role + x).encode()).hexdigest()}", "a") as f:
                    f.write("x")
            return [["Final answer: Yes"]] * len(prompts)

        def close(self):
            open(f"{log}/closed", "a").close()

    rows = [(i, "broken?" if i == 3 else f"question {i}?", "p", "yes") for i in range(6)]
    samples = spark.createDataFrame(rows, SAMPLES)
    pairs, failed = training.generate_pairs(spark, samples, f"{tmp_path}/out", "critic", 0, G.model_responder(Model), rounds=2, simulations=2)
    assert [tuple(r) for r in failed.collect()] == [(3, "round 0 actor: RuntimeError: cannot say")]
    assert sorted(r.sample_id for r in pairs.collect()) == [0, 1, 2, 4, 5]
    asked = [len(open(x).read()) for x in tmp_path.glob("asked-*")]
    first = {hashlib.md5(f"actorQuestion: question {i}?\nPassage: p\nReply yes or no.".encode()).hexdigest() for i in (0, 1, 2, 4, 5)}
    counts = {x.name[6:]: len(x.read_text()) for x in tmp_path.glob("asked-*")}
    assert asked and all(counts[x] == 1 for x in first) and (tmp_path / "closed").exists()


def test_guided_first_round(spark):
    seen = []

    def respond(rows, role, prompt, sim, out):
        seen.append(role)
        return rows.withColumn(out, G.reply_of(prompt))

    states = spark.createDataFrame([(1, "q", "p", "yes", 0, [], "no"), (1, "q", "p", "yes", 1, ["x"], "no")], SAMPLES + ", round int, history array<string>, target string")
    got = {r["round"]: r for r in P.guided_round(states, respond).collect()}
    assert seen == ["actor", "critic"] and "Others:" not in got[0].actor_response and "Others:\nPerson 1 said: x" in got[1].actor_response
    assert "Argue for no" in got[0].actor_response and "Steer towards no" in got[1].critic_response


def test_splits_without_hot_tasks(spark):
    """Sizes are floors, no stratum meets in a task, repeated and null strata are strata."""
    rows = spark.range(10_000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, None).otherwise(F.when(F.col("id") % 3 == 1, "a").otherwise("b")).alias("s"))
    got = D.stratified_split(rows, "s", "k")
    sizes = {(r.s, r.split): r["count"] for r in got.groupBy("s", "split").count().collect()}
    assert sizes[None, "test"] == 3334 // 4 and sizes[None, "validation"] == 333 and sum(sizes.values()) == 10_000
    order = {s: sorted(hashlib.md5(f"42|{k}".encode()).hexdigest() for k in range(10_000) if k % 3 == i) for i, s in enumerate((None, "a", "b"))}
    for r in got.where("k < 500").collect():
        at, n = order[r.s].index(hashlib.md5(f"42|{r.k}".encode()).hexdigest()) + 1, len(order[r.s])
        assert r.split == ("test" if at <= n // 4 else "validation" if at <= n // 4 + n // 10 else "train")
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "SinglePartition" not in plan and "RangePartitioning" not in plan
    assert D.stratified_split(rows.limit(0), "s", "k").count() == 0


def test_named_responses(spark):
    got = spark.range(1).select(D.named_responses_text(F.create_map(F.lit(2), F.lit("b"), F.lit(1), F.lit("a")))).first()[0]
    assert got == "\nPerson 1 said: a\nPerson 2 said: b"


def test_stores_of_results(spark, tmp_path):
    pair = spark.createDataFrame([(1, "p", "cp", "+", "-", "c+", "c-", 1, 0.5, "towards"), (2, None, "cp", "+", "-", "c+", "c-", 1, None, "away")], stores.PAIRS)
    stores.write_array(pair, f"{tmp_path}/array")
    assert sorted(stores.read_pairs(spark, f"{tmp_path}/array", whole_array=True).collect()) == sorted(pair.collect())
    turns = spark.createDataFrame([(1, 0, "NO", "yes"), (1, 1, "YES", "yes")], "sample_id long, round int, actor_answer string, answer string")
    assert training.validation_record(turns, 4)["val_accuracy"] == 1.0 and training.validation_record(turns.limit(0), 4)["iteration"] == 4
    with pytest.raises(ValueError):
        training.train_on_pairs(None, pair.limit(0), f"{tmp_path}/none", "actor", "m")
    sent = []

    class Own(stores.NoTracker):
        def send(self, values, step):
            sent.append((values, step))

    log = stores.MetricLog(spark, f"{tmp_path}/log", Own())
    log.metrics("train", {"loss": 2}, 3)
    log.close()
    assert sent == [({"train/loss": 2}, 3)] and log.read().first().metrics == {"loss": 2.0}
    assert len(stores.setup_logging(path=f"{tmp_path}/x.log").handlers) == len(stores.setup_logging(path=f"{tmp_path}/x.log").handlers) == 2


def test_text_rows(spark, tmp_path):
    (tmp_path / "bbh").mkdir()
    (tmp_path / "bbh" / "x.txt").write_text("".join(f"row {i}\n" for i in range(20)))
    got = S.load_dataset(spark, "bbh", str(tmp_path), "text")
    assert got.count() == 20 and {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"test": 5, "validation": 2, "train": 13}


def test_settings(tmp_path):
    s = config.Settings(config.DEFAULTS, {"deliberation": {"rounds": 2}}, None)
    assert (s.get("deliberation.rounds"), s.require("deliberation.simulations"), s.get("no.such", 3)) == (2, 5, 3)
    with pytest.raises(config.MissingSetting):
        s.require("deliberation.none")
    s.with_value("a.b", 1).save(tmp_path / "x.json")
    assert config.Settings.of_files(tmp_path / "x.json", overrides={"seed": 1}).get("a.b") == 1
    assert config.resolve({"a": 1, "b": 2}, {"a": 5, "b": 6, "c": 7}, {"b": None}, {"a"}) == {"a": 5, "b": 2}


def test_standardize(spark):
    raw = spark.createDataFrame([(1, "q", ["x", "y"], 1), (2, None, [], 3), (3, "r", ["x", "y"], 5)], "sample_id long, question string, choices array<string>, answer int")
    assert [(r.answer, r.question) for r in S.standardize(raw, "multiple_choice").orderBy("sample_id").collect()] == [("B", "q"), ("D", ""), ("", "r")]
    arc = spark.createDataFrame([(1, {"text": ["x"], "label": []}, "(b)")], "sample_id long, choices struct<text:array<string>,label:array<string>>, answerKey string")
    row = S.standardize(arc, "multiple_choice").first()
    assert (row.answer, row.choice_labels) == ("B", ["A"])
    mixed = spark.createDataFrame([(1, "in", "out")], "sample_id long, input string, target string")
    assert S.standardize(mixed, "mixed").first().question == ""
    assert S.standardize(mixed, "mixed", legacy=False).first().answer == "out"
    with pytest.raises(ValueError):
        S.spec_of("none")


def test_load_and_select(spark, tmp_path):
    rows = [(i, "train" if i % 2 else "validation", f"q {i}", "True" if i % 3 else "no") for i in range(10)]
    spark.createDataFrame(rows, "sample_id long, split string, question string, answer string").write.parquet(f"{tmp_path}/boolq")
    found = S.load_dataset(spark, "boolq", str(tmp_path))
    assert S.evaluation_rows(found).count() == 5
    assert [r.sample_id for r in S.first_samples(found, 2).collect()] == [0, 1] and S.first_samples(found, 0).count() == 10
    spark.createDataFrame([(i, "t", "q") for i in range(100)], "sample_id long, bbh_task string, input string").write.parquet(f"{tmp_path}/bbh")
    assert {r["split"]: r["count"] for r in S.load_dataset(spark, "bbh", str(tmp_path), legacy=False).groupBy("split").count().collect()} == {"test": 25, "validation": 10, "train": 65}


def test_prompt_with_missing_choices(spark):
    two = spark.range(1).select(prompts.render("arc", "single_shot", F.lit("why {choice_a}?"), choices=F.array(F.lit("x"), F.lit("y")))).first()[0]
    assert "why x?" in two and "A: x\nB: y\nC: {choice_c}\nD: {choice_d}" in two
    none = spark.range(1).select(prompts.render("arc", "single_shot", F.lit("why {choice_a}?"), choices=F.array().cast("array<string>"))).first()[0]
    assert "why {choice_a}?" in none and "A: \nB: " in none
    for bad in (("none", "critic"), ("arc", "none")):
        with pytest.raises(ValueError):
            prompts.template(*bad)


@pytest.mark.parametrize(("values", "threshold", "wanted"), [((0.5, 1.0, 0.0), 0.3, ("towards", 0.5)), ((0.5, 0.6, 0.0), 0.3, ("away", 0.5)), ((0.5, 0.55, 0.45), 0.3, None), ((0.5, 0.5, 0.5), 0.0, ("towards", 0.0))])
def test_select_pair(spark, values, threshold, wanted):
    got = spark.range(1).select(P.select_pair(*map(F.lit, values), threshold).alias("p")).first().p
    assert (got and tuple(got)) == wanted


def test_stores_and_alternation(spark, tmp_path):
    one_pair = spark.createDataFrame([(1, "p", "cp", "+", "-", "c+", "c-", 1, 0.5, "towards")], stores.PAIRS)
    stores.write_pairs(one_pair, f"{tmp_path}/pairs.json")
    assert stores.read_pairs(spark, f"{tmp_path}/pairs.json").collect() == one_pair.collect()
    calls = []

    class Named:
        def train(self, agent, preferences, base):
            calls.append((agent, base, stores.read_preferences(spark, preferences, agent).count()))
            return f"{base}+"

    made = []
    got = training.alternate(spark, str(tmp_path), {"actor": "a", "critic": "c"}, lambda m: made.append(m) or one_pair, Named(), lambda m: 0.5, iterations=5, patience=1)
    assert calls == [("critic", "c", 1), ("actor", "a", 1), ("critic", "c+", 1), ("actor", "a+", 1)]
    assert (got.stopped, got.best, len(got.history)) == (True, 0.5, 2)
    training.alternate(spark, str(tmp_path), {"actor": "a", "critic": "c"}, lambda m: made.append(m) or one_pair, Named(), reuse=True)
    assert len(made) == 4
    with pytest.raises(ValueError):
        training.alternate(spark, str(tmp_path), {"actor": "a", "critic": "c"}, lambda m: one_pair.limit(0), Named())


def test_metrics_stream(spark, tmp_path):
    stores.append_metrics(spark, f"{tmp_path}/m", "eval", {"acc": 0.5}, 1)
    stores.append_metrics(spark, f"{tmp_path}/m", "eval", {"acc": 1.0}, 2)
    query = metrics.windowed_metrics(metrics.metrics_stream(spark, f"{tmp_path}/m"), "1000 days").writeStream.format("memory").outputMode("complete").queryName("m").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination()
    assert spark.table("m").select("phase", "metric", "n", "mean").collect() == [("eval", "acc", 2, 0.75)]


def test_evaluation(spark):
    turns = [(1, 0, "NO", "yes"), (1, 1, "YES", "yes"), (2, 0, None, "yes"), (2, 1, None, "yes")]
    rows = spark.createDataFrame(turns, "sample_id long, round int, actor_answer string, answer string")
    row = E.evaluate(rows).first()
    assert (row.num_samples, row.per_round_accuracy, row.per_round_delta, row.correct_at_each_round) == (2, [0.0, 0.5], [0.5], [0, 1])
    assert row.flip_statistics.wrong_to_correct == 1 and row.improvement_rate == 0.0
    assert E.evaluate(rows.limit(0)).count() == 0 and E.report(E.evaluate(rows.limit(0))) == "No samples."


def test_isolate(spark):
    def half(row):
        return {"id": row["id"], "half": 10 // row["id"]}

    got = {r.id: (r.half, r.error) for r in D.isolate(spark.range(3), half, "id long, half long").collect()}
    assert got[2] == (5, None) and got[0][0] is None and got[0][1].startswith("ZeroDivisionError")
