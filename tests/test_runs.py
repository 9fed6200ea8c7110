"""Failed replies, resumed runs, the runtime of models, the trainer, arrays, data sets and live metrics."""

import json
import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy import config
from colloquy.functions import answers as A
from colloquy.plans import deliberation as P
from colloquy.plans import dpo, experiment, prompts, training
from colloquy.plans import evaluation as E
from colloquy.plans import generation as G
from colloquy.sources import arrow, datasets, stores
from colloquy.streaming import metrics

SAMPLES = "sample_id long, question string, passage string, answer string"


def samples_of(spark, ids):
    return spark.createDataFrame([(i, f"question {i}?", "p", "yes") for i in ids], SAMPLES)


def responder(fails, log=None):
    """Says yes or no by the prompt's length; fails where fails(prompt) has a reason; notes each prompt that it answers."""

    class Says:
        def __init__(self, role):
            self.role = role

        def generate(self, asked, sampling):
            for x in asked:
                if fails(x):
                    raise RuntimeError(fails(x))
            if log:
                with open(f"{log}/{os.getpid()}", "a", encoding="utf-8") as f:
                    f.writelines(json.dumps([self.role, x]) + "\n" for x in asked)
            return [["Final answer: " + ("Yes" if len(x) % 2 else "No")] for x in asked]

        def close(self):
            return None

    return G.model_responder(Says)


def asked(log):
    return Counter(line for name in os.listdir(log) for line in open(f"{log}/{name}", encoding="utf-8"))


STAGES = {
    "natural": ("Reply yes", "round 0 actor: RuntimeError: broken"),
    "critic": ("Give feedback", "round 0 critic: RuntimeError: broken"),
    "guided": ("Argue for", "round 1 guided actor: RuntimeError: broken"),
    "steered": ("Steer towards", "round 1 guided critic: RuntimeError: broken"),
}


@pytest.mark.parametrize("stage", [*STAGES, "simulated", "silent"])
def test_failures_at_each_stage(spark, tmp_path, stage):
    """A sample of which a reply fails at any stage gives no pair and has its reason; the others give pairs without nulls."""
    if stage == "simulated":
        # with three earlier replies a prompt is one of a simulation, in two rounds
        fails, wanted = (lambda x: "broken" if "question 2?" in x and "Person 3" in x and "Argue" not in x and "review" not in x else None), "round 1 simulated actor: RuntimeError: broken"
    elif stage == "silent":
        fails, wanted = (lambda x: None), None
    else:
        mark, wanted = STAGES[stage]
        fails = lambda x: "broken" if "question 2?" in x and mark in x else None
    respond = responder(fails)
    if stage == "silent":
        inner = respond
        respond = lambda rows, role, prompt, sim, out: inner(rows, role, prompt, sim, out).withColumn(out, F.when(F.col("sample_id") == 2, G.reply_of(F.lit(None).cast("string"))).otherwise(F.col(out)))
        wanted = "round 0 actor: no reply"
    pairs, failed = training.generate_pairs(spark, samples_of(spark, range(4)), f"{tmp_path}/out", "critic", 0, respond, rounds=2, simulations=2)
    assert [tuple(r) for r in failed.collect()] == [(2, wanted)]
    found = pairs.collect()
    assert {r.sample_id for r in found} == {0, 1, 3} and not any(x is None for r in found for x in r)
    in_one_plan = P.preference_pairs(P.deliberate(samples_of(spark, range(4)), 2, respond), 2, respond=respond)
    assert sorted(map(str, in_one_plan.collect())) == sorted(map(str, found))


def test_failed_simulations_are_not_wrong(spark):
    states = spark.createDataFrame([(1, "q", "p", "yes", 0, [], "a", "c"), (2, "q", "p", "", 0, [], "a", "c"), (3, "ok", "p", "yes", 0, [], "a", "c")], SAMPLES + ", round int, history array<string>, actor_response string, critic_response string")
    respond = responder(lambda x: "no" if "Question: q" in x else None)
    got = {r.sample_id: (r.reward, r.error) for r in P.rewards(states, ["sample_id"], 3, respond).collect()}
    assert got[1] == (None, "round 0 simulated actor: RuntimeError: no") and got[2] == (0.0, None) and got[3][1] is None and got[3][0] in (0.0, 1.0)


def test_evaluation_without_failed_samples(spark):
    turns = [(1, 0, "NO", "yes", None, 1.0), (1, 1, "YES", "yes", None, 2.0), (2, 0, None, "yes", "round 0 actor: x", 9.0), (2, 1, None, "yes", "round 0 actor: x", 9.0)]
    rows = spark.createDataFrame(turns, "sample_id long, round int, actor_answer string, answer string, error string, seconds double")
    row = E.evaluate(rows).first()
    assert (row.num_samples, row.num_failed, row.per_round_accuracy, row.total_seconds, row.average_seconds) == (1, 1, [0.0, 1.0], 3.0, 3.0)
    assert E.evaluate(rows.where("sample_id = 2")).count() == 0


class Stop(Exception):
    pass


def test_resumed_run(spark, tmp_path):
    """A run that breaks off goes on: no prompt is answered twice, and the result is that of an unbroken run, also when samples come later."""
    how = {"batches": 4, "rounds": 2, "simulations": 2}
    logs = [str(tmp_path / x) for x in ("whole", "parts")]
    for x in logs:
        os.mkdir(x)
    whole, no_failures = training.generate_resumably(spark, samples_of(spark, range(12)), f"{tmp_path}/a", "actor", 0, responder(lambda x: None, logs[0]), **how)
    calls = []
    committed = stores.Ledger.commit

    def breaks_off(self, name, entry):
        calls.append(name)
        if len(calls) == 3:
            raise Stop
        return committed(self, name, entry)

    stores.Ledger.commit = breaks_off
    try:
        with pytest.raises(Stop):
            training.generate_resumably(spark, samples_of(spark, range(10)), f"{tmp_path}/b", "actor", 0, responder(lambda x: None, logs[1]), **how)
    finally:
        stores.Ledger.commit = committed
    got, _ = training.generate_resumably(spark, samples_of(spark, range(12)), f"{tmp_path}/b", "actor", 0, responder(lambda x: None, logs[1]), **how)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect())) and no_failures.count() == 0
    assert asked(logs[1]) == asked(logs[0])
    training.generate_resumably(spark, samples_of(spark, range(12)), f"{tmp_path}/b", "actor", 0, responder(lambda x: "asked again"), **how)
    nothing = training.generate_resumably(spark, samples_of(spark, []), f"{tmp_path}/c", "actor", 0, responder(lambda x: None), **how)
    assert [x.count() for x in nothing] == [0, 0]


def test_uncommitted_stores_are_not_taken(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    stores.cached(spark, str(tmp_path), "actor", 0, make)
    os.remove(tmp_path / "agent=actor" / "iteration=0" / "_SUCCESS")
    assert stores.cached(spark, str(tmp_path), "actor", 0, make).count() == 3 and len(made) == 2
    assert stores.cached(spark, str(tmp_path), "actor", 0, make).count() == 3 and len(made) == 2


PAIR = (1, "p", "cp", "+", "-", "c+", "c-", 1, 0.5, "towards")


def test_preferences_leave_no_stale_rows(spark, tmp_path):
    """A second call whose least delta leaves nothing raises, in place of training on the first one's rows."""

    class Counts:
        def train(self, agent, preferences, base):
            return f"{base}/{stores.read_preferences(spark, preferences, agent).count()}"

    pairs, path = spark.createDataFrame([PAIR], stores.PAIRS), f"{tmp_path}/p"
    assert training.train_on_pairs(Counts(), pairs, path, "actor", "m") == "m/1"
    assert training.train_on_pairs(Counts(), pairs, path, "critic", "m") == "m/1"
    with pytest.raises(ValueError):
        training.train_on_pairs(Counts(), pairs, path, "actor", "m", min_delta=0.9)
    assert stores.read_preferences(spark, path, "critic").count() == 1
    stores.write_preferences(training.preference_rows(pairs.limit(0)), path)
    assert stores.read_preferences(spark, path, "critic").count() == 0


@pytest.mark.parametrize("at", range(7))
def test_alternation_goes_on_after_each_phase(spark, tmp_path, at):
    """Broken off before any phase or validation, a second run ends as an unbroken one, and finished phases are not run again."""
    pairs, done = spark.createDataFrame([PAIR], stores.PAIRS), []

    def may_break(what):
        if len(done) == at and "broken" not in done:
            done.append("broken")
            raise Stop
        done.append(what)

    class Named:
        def train(self, agent, preferences, base):
            may_break(agent)
            return f"{base}+{agent[0]}"

    def validate(models):
        may_break("validate")
        return float(len(models["actor"]))

    def go():
        return training.alternate(spark, f"{tmp_path}/r", {"actor": "a", "critic": "c"}, lambda m: pairs, Named(), validate, iterations=2, patience=1, reuse=True)

    if at < 6:
        with pytest.raises(Stop):
            go()
    out = go()
    assert out.models == {"actor": "a+a+a", "critic": "c+c+c"} and out.best == 5.0 and [x["val_accuracy"] for x in out.history] == [3.0, 5.0]
    assert [x for x in done if x != "broken"] == ["critic", "actor", "validate"] * 2


def test_train_agent(spark, tmp_path):
    """One call from samples to weights that prefer what was chosen."""
    trainer = dpo.LogLinearTrainer(spark, str(tmp_path), dpo.Objective(beta=1.0, nll=0.1, rate=5.0, steps=8), buckets=64)
    respond = responder(lambda x: "no" if "question 3?" in x else None)
    model, failed = training.train_agent(spark, samples_of(spark, range(5)), f"{tmp_path}/run", "actor", 0, trainer, "none", respond, batches=2, rounds=2, simulations=2)
    assert [r.sample_id for r in failed.collect()] == [3] and trainer.losses == sorted(trainer.losses, reverse=True)
    assert len(dpo.read_weights(spark, model, 64)) == 64


WORDS = ["yes", "no", "maybe so", "it is yes", "", None, "no no no", "ein Wort"]


def losses_by_hand(rows, weights, reference, o, buckets):
    from hashlib import md5

    total = lambda w: math.log(sum(map(math.exp, w)))
    of = lambda t: [int(md5(x.encode()).hexdigest()[:8], 16) % buckets for x in (t or "").lower().split()]
    log_p = lambda t, w: sum(w[b] for b in of(t)) - len(of(t)) * total(w)
    out = 0.0
    for yes, no in rows:
        margin = log_p(yes, weights) - log_p(yes, reference) - log_p(no, weights) + log_p(no, reference)
        out += math.log1p(math.exp(-o.beta * margin)) - o.nll * log_p(yes, weights) / max(1, len(of(yes)))
    return out / len(rows)


def test_gradient_by_finite_differences(spark):
    rng, buckets, o = random.Random(6), 16, dpo.Objective(beta=0.7, nll=0.3)
    rows = [(rng.choice(WORDS), rng.choice(WORDS)) for _ in range(30)]
    weights, reference = ([rng.uniform(-1, 1) for _ in range(buckets)] for _ in range(2))
    packed = dpo.packed(spark.createDataFrame(rows, "chosen string, rejected string"), buckets)
    found = dpo.step(packed, weights, reference, o)
    assert found.loss == pytest.approx(losses_by_hand(rows, weights, reference, o, buckets), abs=1e-9)
    for b in range(buckets):
        near = [weights[:b] + [weights[b] + e] + weights[b + 1 :] for e in (1e-5, -1e-5)]
        up, down = (losses_by_hand(rows, w, reference, o, buckets) for w in near)
        assert found.gradient[b] == pytest.approx((up - down) / 2e-5, abs=1e-7)
    assert dpo.step(packed.limit(0), weights, reference, o) is None


def test_trainer_starts_from_its_base(spark, tmp_path):
    preferences = spark.createDataFrame([(1, "p", "good answer", "bad answer", 1, 0.5, "towards", "actor")], stores.PREFERENCES)
    stores.write_preferences(preferences, f"{tmp_path}/p")
    trainer = dpo.LogLinearTrainer(spark, str(tmp_path), dpo.Objective(steps=3), buckets=32)
    first = trainer.train("actor", f"{tmp_path}/p", "no model")
    losses = trainer.losses
    second = trainer.train("actor", f"{tmp_path}/p", first)
    assert first != second and losses[0] > losses[-1] and trainer.losses[0] < losses[0]
    with pytest.raises(ValueError):
        trainer.train("critic", f"{tmp_path}/p", first)


def logged_model(log):
    class Logged:
        """Notes loads and calls; fails on one word; the wrong number of texts for another."""

        def __init__(self):
            open(f"{log}/load-{random.Random().random()}", "w").close()

        def generate(self, asked, sampling):
            with open(f"{log}/calls", "a", encoding="utf-8") as f:
                f.write(json.dumps([len(x) for x in asked]) + "\n")
            if any("fail" in x for x in asked):
                raise ValueError("can't")
            return [[f"{x}#{i}|tail" for i in range(sampling.n)] for x in asked if "short" not in x]

        def close(self):
            open(f"{log}/close-{random.Random().random()}", "w").close()

    return Logged


def test_runtime(spark, tmp_path):
    """n texts a prompt in order, stop strings, failures by themselves, null prompts not asked, one load a task, calls within the budget."""
    log = str(tmp_path)
    texts = [(i, None if i % 7 == 0 else "fail" if i == 5 else "short" if i == 9 else "w" * (1 + i * 13 % 97)) for i in range(60)]
    rows = spark.createDataFrame(texts, "i long, p string").repartition(3)
    out = G.samples_of(G.generate(rows, F.col("p"), logged_model(log), G.Sampling(n=2, max_tokens=5, stop=("|",)), budget=100)).collect()
    assert len(out) == 120 and Counter(r.draw for r in out) == {0: 60, 1: 60}
    for r in out:
        p = dict(texts)[r.i]
        wanted = (None, None) if p is None else (None, "ValueError: can't") if p == "fail" else (None, "ValueError: 2 texts for each of 1 prompts were asked for") if p == "short" else (f"{p}#{r.draw}", None)
        assert (r.text, r.error) == wanted and r.seconds >= 0
    names = os.listdir(log)
    assert sum(x.startswith("load") for x in names) == sum(x.startswith("close") for x in names) == 3
    sizes = [json.loads(x) for x in open(f"{log}/calls", encoding="utf-8")]
    assert all(len(x) == 1 or len(x) * (max(x) // 4 + 11) <= 100 for x in sizes) and any(len(x) > 2 for x in sizes)
    assert G.generate(rows.limit(0), F.col("p"), logged_model(log)).count() == 0
    with pytest.raises(ValueError):
        G.generate(rows, F.col("p"), logged_model(log), G.Sampling(n=0))


def test_sampling_of_settings():
    settings = config.Settings(config.DEFAULTS, {"generation": {"stop": ["x"], "max_tokens": 9, "other": 1}})
    assert G.sampling_of(settings, n=2) == G.Sampling(n=2, max_tokens=9, temperature=0.7, top_p=0.9, stop=("x",))


def test_generate_single():
    model = G.CannedModel()
    assert G.generate_single(model, "x", G.Sampling(temperature=0.0)) == model.generate(["x"], G.Sampling(n=2, temperature=0.0))[0][1]

    class Silent(G.CannedModel):
        def generate(self, prompts, sampling):
            return [[]]

    assert G.generate_single(Silent(), "x") == ""


RECORDS = [(i, f'a "quote", [x], {{y}}, \\ and é\n  {{', "cp", "}, {", "]" if i % 2 else "[", None, "c-", i % 3, 0.5, "towards") for i in range(400)]


@pytest.mark.parametrize("layout", [stores.LINES, stores.INDENTED])
def test_arrays_are_split(spark, tmp_path, layout):
    """Many tasks read one array, none of them a record twice, whatever its strings hold."""
    names = [x.split()[0] for x in stores.PAIRS.split(", ")]
    pairs = spark.createDataFrame(RECORDS, stores.PAIRS)
    if layout == stores.LINES:
        stores.write_array(pairs.repartition(3), str(tmp_path / "a"))
        files = [x for x in os.listdir(tmp_path / "a") if x.startswith("part")]
        assert len(files) == 1 and len(json.loads((tmp_path / "a" / files[0]).read_text())) == len(RECORDS)
    else:
        (tmp_path / "a").mkdir()
        (tmp_path / "a" / "x.json").write_text(json.dumps([dict(zip(names, r, strict=True)) for r in RECORDS], indent=2, ensure_ascii=False), encoding="utf-8")
    small = spark.newSession()
    small.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    got = stores.read_array(small, str(tmp_path / "a"), layout=layout)
    assert got.rdd.getNumPartitions() > 5
    assert sorted(map(str, got.collect())) == sorted(map(str, pairs.collect()))
    assert sorted(map(str, stores.read_pairs(spark, str(tmp_path / "a"), whole_array=True).collect())) == sorted(map(str, pairs.collect()))


def test_arrays_at_the_edges(spark, tmp_path):
    pairs = spark.createDataFrame(RECORDS[:5], stores.PAIRS)
    stores.write_array(pairs.repartition(4), str(tmp_path / "many"), files=None)
    files = [tmp_path / "many" / x for x in os.listdir(tmp_path / "many") if x.startswith("part")]
    assert len(files) > 1 and sum(len(json.loads(x.read_text())) for x in files) == 5
    assert stores.read_array(spark, str(tmp_path / "many")).count() == 5
    stores.write_array(pairs.limit(0), str(tmp_path / "none"))
    assert stores.read_array(spark, str(tmp_path / "none")).count() == 0
    for name, text in (("empty", "[]"), ("one", json.dumps([{"sample_id": 1}], indent=2)), ("blank", "[\n]\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text(text)
        assert stores.read_array(spark, str(tmp_path / name), layout=stores.INDENTED).count() == (name == "one")
    (tmp_path / "one" / "x.json").write_text('[\n  {\n    "sample_id": "no number"\n  }\n]')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        stores.read_array(spark, str(tmp_path / "one"), layout=stores.INDENTED).collect()
    with pytest.raises(ValueError):
        stores.read_array(spark, str(tmp_path / "one"), layout="other")


def test_arrow_dataset(spark, tmp_path):
    """Round trip by agent; replaced, emptied and added to; what no manifest lists is not read; others' readers open the files."""
    import pyarrow as pa

    rows = training.preference_rows(spark.createDataFrame([(i, *PAIR[1:]) for i in range(50)], stores.PAIRS).repartition(4))
    assert arrow.write_by_agent(rows, str(tmp_path), stores.AGENTS) == ["actor", "critic"]
    got = arrow.read_dataset(spark, f"{tmp_path}/actor")
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.where("agent = 'actor'").drop("agent").collect()))
    files = arrow.manifest(f"{tmp_path}/actor")
    assert len(files) == 4 and got.rdd.getNumPartitions() == 4
    assert sum(pa.ipc.open_stream(f"{tmp_path}/actor/{x}").read_all().num_rows for x in files) == 50
    (tmp_path / "actor" / "data-left-over.arrow").write_bytes(b"x")
    assert arrow.read_dataset(spark, f"{tmp_path}/actor").count() == 50
    rows.where("agent = 'actor'").drop("agent").limit(3).write.format("arrow_dataset").mode("append").save(f"{tmp_path}/actor")
    assert arrow.read_dataset(spark, f"{tmp_path}/actor").count() == 53
    assert arrow.write_by_agent(rows.where("agent = 'critic' and sample_id < 2"), str(tmp_path), stores.AGENTS) == ["critic"]
    assert arrow.read_dataset(spark, f"{tmp_path}/critic").count() == 2
    with pytest.raises(Exception, match="state.json"):
        arrow.read_dataset(spark, f"{tmp_path}/actor").count()


@pytest.mark.parametrize("n", [0, 2, 4, 5])
def test_templates_by_table(spark, n):
    """Rows of all sets and types in one plan are what each renders by itself; names inside values too."""
    choices = F.array(*[F.lit(x) for x in ("red {choice_d}", "blue", "{question}", "green", "more")[:n]]).cast("array<string>")
    given = {"question": F.lit("why {choice_b}?"), "passage": F.lit("{question}"), "choices": choices, "responses": F.array(F.lit("a"), F.lit("b {actor_response}")), "target_answer": F.lit("B"), "actor_response": F.lit(None).cast("string")}
    kinds = [(d, t) for d in prompts.datasets() for t in prompts.TYPES]
    rows = spark.createDataFrame([*kinds, ("none", "critic"), ("arc", "none")], "dataset string, prompt_type string")
    got = {(r.dataset, r.prompt_type): r.prompt for r in prompts.render_rows(rows, prompts.values_of(**given), F.size(choices)).collect()}
    one = spark.range(1)
    wanted = one.select(*[prompts.render(d, t, **given).alias(f"{d}-{t}") for d, t in kinds]).first().asDict()
    assert {f"{d}-{t}": v for (d, t), v in got.items() if (d, t) in kinds} == wanted
    assert got["none", "critic"] is None and got["arc", "none"] is None


def test_live_early_stop(spark, tmp_path):
    """Files in two runs of the stream, with late, repeated and empty records; the end is the fold over all of them."""
    rng = random.Random(9)
    series = {p: [round(rng.random(), 3) for _ in range(9)] for p in ("a", "b", "c")}
    records = [(p, i, {"acc": v, "other": 1.0}) for p, x in series.items() for i, v in enumerate(x)]
    rng.shuffle(records)
    records += [records[0], ("a", None, {"acc": 9.0}), ("b", 50, {"other": 2.0}), (None, 1, {"acc": 9.0})]

    def put(rows):
        spark.createDataFrame(rows, "phase string, step long, metrics map<string,double>").withColumn("timestamp", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{tmp_path}/m")

    def run():
        out = metrics.live_early_stop(metrics.metrics_stream(spark, f"{tmp_path}/m"), "acc", 2, 0.01)

        def keep(batch, epoch):
            batch.write.mode("append").parquet(f"{tmp_path}/out/epoch={epoch}")

        out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()

    put(records[:14])
    run()
    put(records[14:])
    run()
    rows = spark.read.parquet(f"{tmp_path}/out")
    last = {r.phase: r for r in rows.groupBy("phase").agg(F.max_by(F.struct(*rows.columns), "epoch").alias("x")).select("x.*").collect()}
    wanted = spark.createDataFrame(list(series.items()), "phase string, series array<double>").select("phase", P.early_stop_column(F.col("series"), 2, 0.01).alias("ran")).collect()
    assert {p: (r.ran, r.records) for p, r in last.items()} == {r.phase: (r.ran, 9) for r in wanted}
    assert all(r.stopped == (P.early_stop([*series[p], 99.0], 2, 0.01) == r.ran) for p, r in last.items())


def test_tracking_sends_an_epoch_once(spark, tmp_path):
    sent = []

    class Own(stores.NoTracker):
        def send(self, values, step):
            if step == 2 and "down" not in sent:
                sent.append("down")
                raise RuntimeError("tracker is down")
            sent.append((values, step))

    for i in range(4):
        stores.append_metrics(spark, f"{tmp_path}/m", "eval", {"acc": float(i)}, i)
    ledger = stores.Ledger(spark, f"{tmp_path}/ledger")

    def run(checkpoint):
        writer = metrics.track(metrics.metrics_stream(spark, f"{tmp_path}/m"), Own(), ledger)
        writer.option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="tracker is down"):
        run("c")
    run("c")
    run("other")  # a replay of epoch 0
    assert [x for x in sent if x != "down"] == [({"eval/acc": float(i)}, i) for i in range(4)]


def test_ledger(spark, tmp_path):
    ledger = stores.Ledger(spark, f"{tmp_path}/l")
    assert ledger.names() == [] and ledger.get("x") is None
    assert ledger.commit("x", {"a": "é"}) and not ledger.commit("x", {"a": 2}) and ledger.commit("w", {})
    assert ledger.get("x") == {"a": "é"} and ledger.names() == ["w", "x"]


def test_settings_by_row(spark):
    """Columns resolve as the driver does."""
    layers = [({"a": 1, "b": 2}, {"a": 5, "b": 6, "c": 7}, {"b": None}), ({"a": 1, "b": 2}, {}, {"a": 3, "z": 1}), ({}, {"a": 1}, {"b": 2})]
    rows = spark.createDataFrame(layers, "d map<string,int>, c map<string,int>, s map<string,int>")
    got = [r[0] for r in rows.select(config.resolve_column(F.col("d"), F.col("c"), F.col("s"), ("a",))).collect()]
    assert got == [config.resolve(d, c, s, {"a"}) for d, c, s in layers]
    rows = spark.createDataFrame([(1, "a", 1, 5), (1, "a", 2, None), (1, "b", 1, 1), (1, "b", 3, 2), (2, "a", 0, None), (2, None, 0, 1)], "scope int, name string, layer int, value int")
    assert sorted(tuple(r) for r in config.merged_layers(rows, ["scope"], "name", ["layer"], "value").collect()) == [(1, "a", 5, 1), (1, "b", 2, 2)]


def test_wrong_answer_beyond_the_table(spark):
    choices = [f"C{i}" for i in range(A.LOOKED_UP + 40)]
    got = spark.createDataFrame([(choices,)], "c array<string>").select(A.wrong_answer(F.lit("c0"), F.col("c"))).first()[0]
    assert got == random.Random(42).choice(choices[1:])


def test_settings_of_groups(tmp_path):
    """Six layers, later ones win key by key; layers without a file are left out."""
    for name, content in {"default.json": {"a": 1, "model": {"name": "m0", "type": "t"}}, "model/big.json": {"model": {"name": "m1"}, "b": 1}, "data/set.json": {"data": {"name": "s"}, "b": 2}, "exp.json": {"b": 3, "c": 1}}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(content))
    got = config.Settings.of_groups(tmp_path, {"data": "set", "model": "big", "train": "none"}, tmp_path / "exp.json", ["c=2", "data.size=[1, 2]", "text=plain words"])
    assert (got.model_name, got.get("model.type"), got.get("a"), got.get("b"), got.get("c"), got.dataset, got.get("text")) == ("m1", "t", 1, 3, 2, {"name": "s", "size": [1, 2]}, "plain words")
    assert config.Settings.of_groups(tmp_path / "nowhere").get("seed") == config.DEFAULTS["seed"]
    for bad in ({"groups": {"other": "x"}}, {"overrides": ["none"]}):
        with pytest.raises(ValueError):
            config.Settings.of_groups(tmp_path, **bad)


def test_choices_of_columns(spark):
    """The right answer's letter wherever it stands; missing and repeated distractors, no right answer."""
    rows = [(1, "q", "sun", "moon", "stars", "sea"), (2, "q", "sun", "moon", None, ""), (3, "q", "sun", "sun", "moon", "moon"), (4, "q", None, "a", "b", "c"), (5, None, "x", None, None, None)]
    raw = spark.createDataFrame(rows, "sample_id long, question string, correct_answer string, distractor1 string, distractor2 string, distractor3 string")
    got = {r.sample_id: r for r in datasets.standardize(datasets.choices_of_columns(raw, datasets.spec_of("sciq")), "multiple_choice", legacy=False).collect()}
    for i, _, right, *wrong in rows:
        r = got[i]
        assert sorted(r.choices) == sorted({x for x in (right, *wrong) if x})
        assert r.answer == "" if right is None else r.choices[ord(r.answer) - 65] == right
    assert len({got[i].answer for i in (1, 2, 3)}) >= 1 and got[5].answer == "A"


def test_arrow_paths():
    assert arrow.local("file:///a/b") == arrow.local("file:/a/b") == arrow.local("/a/b") == "/a/b"
    with pytest.raises(ValueError):
        arrow.local("hdfs://host/a")


def test_experiment_goes_on(spark, tmp_path):
    """Broken off in training, an experiment ends as an unbroken one, asks nothing twice, and logs what it measured."""
    samples = samples_of(spark, range(20)).withColumn("split", F.when(F.col("sample_id") % 4 == 0, "test").when(F.col("sample_id") % 4 == 1, "validation").otherwise("train"))
    settings = config.Settings(config.DEFAULTS, {"deliberation": {"rounds": 2, "simulations": 1}, "generation": {"batches": 1}, "training": {"patience": 2}, "evaluation": {"max_samples": 3}})
    trained, logs = [], [str(tmp_path / x) for x in ("whole", "parts")]
    for x in logs:
        os.mkdir(x)

    class Trains:
        def __init__(self, breaks):
            self.breaks = breaks

        def train(self, agent, preferences, base):
            if agent == "actor" and self.breaks:
                raise Stop
            trained.append(agent)
            return f"{base}'"

    def go(at, log, breaks=False):
        metric_log = stores.MetricLog(spark, f"{at}/metrics")
        return experiment.run(spark, samples, at, settings, Trains(breaks), lambda models: responder(lambda x: None, log), log=metric_log), metric_log

    whole, metric_log = go(f"{tmp_path}/a", logs[0])
    with pytest.raises(Stop):
        go(f"{tmp_path}/b", logs[1], breaks=True)
    got, _ = go(f"{tmp_path}/b", logs[1])
    assert got.outcome == whole.outcome and trained == ["critic", "actor"] * 2 and whole.outcome.models == {"actor": "actor'", "critic": "critic'"}
    assert asked(logs[0]) == asked(logs[1])
    assert got.results.drop("total_seconds", "average_seconds").collect() == whole.results.drop("total_seconds", "average_seconds").collect() and whole.details.count() == 3
    assert {r.phase for r in metric_log.read().collect()} == {"generate", "validate", "evaluate"}
    assert spark.read.json(f"{tmp_path}/b/results/summary").first().num_samples == 3


def test_prompts_are_aggregated_once_a_turn(spark):
    """Of the rows that are grouped by turn, fifteen a turn, one has the turn's prompts and three have replies: the others carry no text."""
    from pyspark.sql.classic.dataframe import DataFrame

    turns = P.deliberate(spark.createDataFrame([(i, f"question {i}?", "p" * 999, "yes") for i in range(4)], SAMPLES), 3)
    plan = P.scored_variants(turns, 5)._jdf.queryExecution().optimizedPlan()
    grouped = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan.child()), spark)
    texts = [c for c, kind in grouped.dtypes if kind == "string" and c not in ("variant", "error")]
    held = grouped.agg(F.count(F.lit(1)), *[F.count(c) for c in texts], F.sum(sum(F.coalesce(F.length(c), F.lit(0)) for c in texts))).first()
    late = turns.where("round >= 1")
    assert plan.nodeName() == "Aggregate" and held[0] == 15 * late.count()
    assert late.agg(F.sum(F.length("actor_prompt") + F.length("critic_prompt"))).first()[0] <= held[-1] < 2200 * late.count() + 999
    assert max(held[1:-1]) <= 3 * late.count()
