"""The registered queries and their SQL."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import config
from .functions import answers as A
from .operators import datasets as D
from .plans import deliberation as P
from .plans import dpo, experiment, prompts, training
from .plans import evaluation as E
from .plans import generation as G
from .sources import arrow, datasets, stores
from .streaming import metrics


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _samples(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").join(_read(spark, d, "labels"), "doc_id")
    return docs.select(F.col("doc_id").alias("sample_id"), F.concat(F.lit("Is document "), F.col("doc_id").cast("string"), F.lit(" good?")).alias("question"), F.coalesce("text", F.lit("")).alias("passage"), D.yes_no_answer((F.col("quality") == 1).cast("string")).alias("answer"))


LANGUAGES = ("en", "fr", "de", "es")


def _choice_samples(spark: SparkSession, d: str) -> DataFrame:
    """Documents as questions for their language, a letter of four choices."""
    index = F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("lang")).cast("int") - 1
    return _read(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.coalesce("text", F.lit("")).alias("question"), D.choice_answer(index, F.lit(None).cast("string"), F.lit(4)).alias("answer"), F.array(*map(F.lit, LANGUAGES)).alias("choices"))


def standardize_yes_no(spark, d):
    return _samples(spark, d)


def standardize_mc(spark, d):
    langs = F.array(*map(F.lit, ("en", "fr", "de", "es")))
    index = F.array_position(langs, F.col("lang")).cast("int") - 1
    n = F.size(langs)
    return _read(spark, d, "documents").select("doc_id", D.choice_answer(index, F.lit(None).cast("string"), n).alias("answer"), F.array_join(D.labels_for(n), ",").alias("labels"))


def extract_yes_no(spark, d):
    return _read(spark, d, "conversations").select("conv_id", "turn", A.extract_yes_no(F.col("text")).alias("answer"))


def extract_mc(spark, d):
    return _read(spark, d, "conversations").select("conv_id", "turn", A.extract_choice(F.col("text")).alias("answer"))


def normalize_answers(spark, d):
    return _read(spark, d, "orders").select("o_orderkey", A.normalize_answer(F.concat(F.lit(" ("), F.col("o_orderpriority"), F.lit(").  "))).alias("answer"))


def wrong_answer_choice(spark, d):
    choices = F.array(*map(F.lit, ("en", "fr", "de", "es")))
    return _read(spark, d, "documents").select("doc_id", A.wrong_answer(F.col("lang"), choices).alias("wrong"))


def stratified_split(spark, d):
    return D.stratified_split(_read(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "lang", "split")


def split_sizes(spark, d):
    return stratified_split(spark, d).groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"))


def dataset_stats_answers(spark, d):
    return D.answer_distribution(_samples(spark, d), "answer").select("answer", "n", F.round("ratio", 9).alias("ratio"))


def interleaved_history(spark, d):
    rows = D.with_history(D.rounds_of(_read(spark, d, "conversations")))
    return rows.select("conv_id", "round", F.size("history").cast("long").alias("n_history"), F.md5(D.responses_text(F.col("history"))).alias("history_md5"), F.size("actor_history").cast("long").alias("n_actor"))


def chat_transcript(spark, d):
    row = F.struct("turn", F.concat(F.initcap("role"), F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))
    out = _read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["line"]), "\n").alias("t"))
    return out.select("conv_id", F.concat("t", F.lit("\nAssistant:")).alias("transcript"))


def detect_model_type(spark, d):
    name = F.concat("p_name", F.when(F.col("p_partkey") % 4 == 0, "-Mistral").when(F.col("p_partkey") % 4 == 1, "-gemma-2").when(F.col("p_partkey") % 4 == 2, "-Qwen3").otherwise("-Llama"))
    return _read(spark, d, "part").select("p_partkey", A.detect_model_type(name).alias("model_type"))


def metrics_jsonl_parse(spark, d):
    k = F.from_json("props", "k long")["k"]
    return _read(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("sum_k"), F.count(k).alias("n"))


def _turns(spark, d):
    return P.deliberate(_samples(spark, d), 3)


def natural_deliberation(spark, d):
    return _turns(spark, d).select("sample_id", "round", "actor_response", "critic_response", "actor_answer")


CHOOSER = G.canned_responder(G.CANNED_CHOICE)


def choice_deliberation(spark, d):
    return P.deliberate(_choice_samples(spark, d), 2, CHOOSER, "mmlu").select("sample_id", "round", "actor_response", "critic_response", "actor_answer")


def mixed_deliberation(spark, d):
    """Yes/no replies where a letter may stand, as mixed tasks have them."""
    return P.deliberate(_choice_samples(spark, d), 2, G.canned_responder(G.CANNED + G.CANNED_CHOICE), "bbh").select("sample_id", "round", "actor_response", "actor_answer")


def choice_rewards(spark, d):
    turns = P.with_earlier(P.deliberate(_choice_samples(spark, d), 2, CHOOSER, "mmlu"))
    return P.rewards(turns, ["sample_id", "round"], 5, CHOOSER, "mmlu").select("sample_id", "round", F.round("reward", 9).alias("reward"))


def guided_round(spark, d):
    """Each sample's first two rounds argued towards the wrong answer."""
    turns = P.with_earlier(P.deliberate(_choice_samples(spark, d), 2, CHOOSER, "mmlu")).drop("actor_response", "critic_response")
    states = turns.withColumn("target", A.wrong_answer(F.col("answer"), F.col("choices")))
    return P.guided_round(states, CHOOSER, "mmlu").select("sample_id", "round", "target", "actor_response", "critic_response")


def _scored(spark, d):
    right = (A.normalize_answer(F.col("actor_answer")) == A.normalize_answer(F.col("answer"))).cast("double")
    return _turns(spark, d).withColumn("right", right)


def per_round_accuracy(spark, d):
    n, acc = F.count(F.lit(1)), F.avg("right")
    return _scored(spark, d).groupBy("round").agg(n.alias("n"), F.round(acc, 9).alias("accuracy"), F.round(P.wilson(acc, n), 9).alias("margin"))


def per_round_delta(spark, d):
    rows = _scored(spark, d).groupBy("round").agg(F.avg("right").alias("a"))
    return rows.select("round", F.round(F.col("a") - F.lag("a").over(Window.orderBy("round")), 9).alias("delta")).where("delta is not null")


def flip_statistics(spark, d):
    ends = E.sample_details(_turns(spark, d))
    return ends.agg(*[F.count_if((F.col("initial_correct") == bool(i)) & (F.col("final_correct") == bool(f))).alias(f"n_{i}{f}") for i in (0, 1) for f in (0, 1)])


def rollout_reward(spark, d):
    out = P.rewards(P.with_earlier(_turns(spark, d)), ["sample_id", "round"], 5)
    return out.select("sample_id", "round", F.round("reward", 9).alias("reward"))


def _pairs(spark, d):
    return P.preference_pairs(_turns(spark, d), 5)


def preference_pairs(spark, d):
    return _pairs(spark, d).withColumn("delta", F.round("delta", 9))


def pairs_min_delta(spark, d):
    return _pairs(spark, d).where("coalesce(delta, 0) >= 0.1").select("sample_id", "round", F.round("delta", 9).alias("delta"), "direction")


def _preferences(spark, d, agent):
    rows = training.preference_rows(_pairs(spark, d)).where(F.col("agent") == agent)
    return rows.select("sample_id", "prompt", "chosen", "rejected", "round", F.round("delta", 9).alias("delta"), "direction")


def prefs_actor(spark, d):
    return _preferences(spark, d, "actor")


def prefs_critic(spark, d):
    return _preferences(spark, d, "critic")


_PAIR = ("sample_id", "round", "direction", "positive", "negative")


def pair_cache_roundtrip(spark, d):
    """Pairs made and stored by agent and iteration, then read from the cache, whose maker must not be asked again."""
    root = stores.scratch(spark, "pairs")
    stores.cached(spark, root, "critic", 0, lambda: _pairs(spark, d))
    return stores.cached(spark, root, "critic", 0, lambda: _pairs(spark, d).limit(0)).select(*_PAIR)


def pairs_jsonl_roundtrip(spark, d):
    path = stores.scratch(spark, "jsonl")
    stores.write_pairs(_pairs(spark, d), path)
    return stores.read_pairs(spark, path).select(*_PAIR)


def preferences_roundtrip(spark, d):
    path = stores.scratch(spark, "preferences")
    stores.write_preferences(training.preference_rows(_pairs(spark, d), 0.1), path)
    return stores.read_preferences(spark, path, "critic").select("sample_id", "round", "chosen", "rejected")


def results_roundtrip(spark, d):
    """A benchmark's row without its details, as the summary file has it."""
    path = stores.scratch(spark, "results")
    stores.write_results(E.evaluate(_turns(spark, d)), path)
    kinds = "num_samples long, final_accuracy double, correct_at_each_round array<long>"
    return spark.read.schema(kinds).json(f"{path}/summary").select("num_samples", F.round("final_accuracy", 9).alias("final_accuracy"), F.array_join("correct_at_each_round", ",").alias("correct"))


def metric_log_roundtrip(spark, d):
    log = stores.MetricLog(spark, stores.scratch(spark, "metrics"))
    for row in _scored(spark, d).groupBy("round").agg(F.avg("right").alias("a")).collect():
        log.metrics("eval", {"accuracy": row["a"], "error": 1 - row["a"]}, row["round"])
    return log.read().select("phase", "step", F.explode("metrics").alias("metric", "value")).withColumn("value", F.round("value", 9))


def standardize_mc_struct(spark, d):
    """Choices as texts with labels of their own, the answer under its other name."""
    texts = F.array(*map(F.lit, LANGUAGES))
    labels = F.when(F.col("doc_id") % 2 == 0, F.array(*map(F.lit, "1234"))).otherwise(F.array().cast("array<string>"))
    raw = _read(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.col("text").alias("question"), F.struct(texts.alias("text"), labels.alias("label")).alias("choices"), F.concat(F.lit("("), F.substring("lang", 1, 1), F.lit(")")).alias("answerKey"))
    out = datasets.standardize(raw, "multiple_choice")
    return out.select("sample_id", F.length("question").alias("n_question"), "answer", F.array_join("choices", ",").alias("choices"), F.array_join("choice_labels", ",").alias("labels"), "task_type")


def standardize_sciq(spark, d):
    """The right answer and the wrong ones in columns of their own."""
    others = [F.get(F.array_except(F.array(*map(F.lit, LANGUAGES)), F.array("lang")), F.lit(i)) for i in range(3)]
    raw = _read(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("question"), F.col("text").alias("support"), F.col("lang").alias("correct_answer"), *[c.alias(f"distractor{i}") for i, c in enumerate(others, 1)])
    out = datasets.standardize(datasets.choices_of_columns(raw, datasets.spec_of("sciq")), "multiple_choice", legacy=False)
    return out.select("sample_id", F.md5("passage").alias("passage_md5"), "answer", F.array_join("choices", ",").alias("choices"))


def load_yes_no(spark, d):
    """A set with splits of its own, of which one has a name that is dropped."""
    root = stores.scratch(spark, "sets")
    docs = _read(spark, d, "documents")
    split = F.get(F.array(*map(F.lit, ("train", "validation", "test", "extra"))), F.pmod("doc_id", F.lit(4)).cast("int"))
    raw = docs.select(F.col("doc_id").alias("sample_id"), split.alias("split"), F.col("source").alias("question"), F.col("lang").alias("passage"), (F.pmod("doc_id", F.lit(3)) == 0).alias("answer"))
    raw.write.parquet(f"{root}/boolq")
    return datasets.load_dataset(spark, "boolq", root).select("sample_id", "split", "question", "passage", "answer", F.array_join("choices", ",").alias("choices"), "task_type")


def load_tasks(spark, d):
    """A set without splits, a folder for each task, split by task."""
    root = stores.scratch(spark, "sets")
    raw = _read(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.md5("text").alias("input"), F.col("source").alias("target"), F.coalesce("lang", F.lit("none")).alias("task"))
    raw.write.partitionBy("task").parquet(f"{root}/bbh")
    return datasets.load_dataset(spark, "bbh", root, legacy=False).select("sample_id", "bbh_task", "split", "question", "answer", "task_type")


def load_lines(spark, d):
    """Rows without fields: lines of text, each the data of a sample of the task that has no name."""
    root = stores.scratch(spark, "sets")
    _read(spark, d, "documents").select(F.concat_ws(" ", F.col("doc_id").cast("string"), F.regexp_replace("text", r"[\r\n]+", " "))).write.text(f"{root}/bbh")
    return datasets.load_dataset(spark, "bbh", root, "text").groupBy("split", "task_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("question") == "").alias("empty"))


def named_history(spark, d):
    """Each conversation's last texts by role, in the order of the roles."""
    last = _read(spark, d, "conversations").groupBy("conv_id", "role").agg(F.max_by(F.coalesce("text", F.lit("")), "turn").alias("text"))
    said = last.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "text"))).alias("said"))
    return said.select("conv_id", F.md5(D.named_responses_text(F.col("said"))).alias("history_md5"))


def no_simulations(spark, d):
    """States without simulations, and states without a label, have no reward to speak of: 0."""
    turns = P.deliberate(_samples(spark, d).withColumn("answer", F.when(F.pmod("sample_id", F.lit(2)) == 0, F.col("answer")).otherwise("")), 2)
    none, unlabelled = P.rewards(turns.where("answer <> ''"), ["sample_id", "round"], 0), P.rewards(turns.where("answer = ''"), ["sample_id", "round"], 3)
    return none.unionByName(unlabelled).select("sample_id", "round", "reward")


def validation_record(spark, d):
    row = training.validation_record(_turns(spark, d), 3)
    return spark.createDataFrame([tuple(row.values())], "iteration int, val_accuracy double, val_ci_margin double, improvement_rate double").select("iteration", *[F.round(c, 9).alias(c) for c in list(row)[1:]])


def split_fallback(spark, d):
    """A set without test rows is evaluated on its validation rows."""
    return datasets.evaluation_rows(stratified_split(spark, d).where("split <> 'test'")).select("doc_id", "lang", "split")


def settings_merge(spark, d):
    """Each user's settings, event by event, merged key by key: later layers win where they have a value."""
    layers = _read(spark, d, "events").select("user_id", F.col("event_type").alias("name"), "ts", "event_id", F.nullif(F.from_json("props", "k long")["k"] % 7, F.lit(0)).alias("value"))
    return config.merged_layers(layers, ["user_id"], "name", ["ts", "event_id"], "value")


def dataset_tasks(spark, d):
    """Documents dealt over the registered sets and one that is unknown, by task type."""
    names = F.array(*map(F.lit, (*prompts.datasets(), "none")))
    rows = _read(spark, d, "documents").select("doc_id", F.get(names, F.pmod("doc_id", F.lit(6)).cast("int")).alias("dataset"))
    return datasets.with_task(rows).groupBy("dataset", "task_type", "known").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def extract_mixed(spark, d):
    return _read(spark, d, "documents").select("doc_id", A.extract_answer(F.col("text"), F.lit("mixed")).alias("answer"))


def sample_details(spark, d):
    return E.sample_details(_turns(spark, d))


def correct_at_each_round(spark, d):
    return E.by_round(_turns(spark, d)).select("round", "correct")


def evaluate_benchmark(spark, d):
    row = E.evaluate(_turns(spark, d))
    rounded = [F.round(c, 9).alias(c) for c in ("initial_accuracy", "final_accuracy", "margin", "ci_low", "ci_high", "improvement_rate", "absolute_gain")]
    return row.select("num_samples", *rounded, F.round(F.element_at("per_round_delta", -1), 9).alias("last_delta"), F.col("flip_statistics.wrong_to_correct").alias("wrong_to_correct"), F.col("flip_statistics.correct_to_wrong").alias("correct_to_wrong"))


def _rendered(spark, d, dataset):
    choices = F.array(F.lit("en"), F.lit("fr"), F.lit("de"), F.coalesce("lang", F.lit("")))
    given = {"question": F.col("text"), "passage": F.col("source"), "choices": None if dataset == "boolq" else choices, "responses": F.array(F.col("source"), F.col("lang")), "target_answer": F.col("lang"), "actor_response": F.col("source")}
    docs = _read(spark, d, "documents").fillna("", ["source", "lang"])
    return docs.select("doc_id", *[F.md5(prompts.render(dataset, t, **given)).alias(t) for t in prompts.TYPES])


def render_prompts_yes_no(spark, d):
    return _rendered(spark, d, "boolq")


def render_prompts_choice(spark, d):
    return _rendered(spark, d, "mmlu")


def render_prompts_alias(spark, d):
    """The other sets of choices render by the same templates."""
    each = [_rendered(spark, d, x).select(F.lit(x).alias("dataset"), "doc_id", "single_shot", "critic") for x in ("arc", "bbh", "sciq")]
    return each[0].unionByName(each[1]).unionByName(each[2])


SET_NAMES = ("arc", "bbh", "boolq", "mmlu", "sciq", "none")


def render_mixed_datasets(spark, d):
    """Prompts of five data sets and six types in one plan; the sixth set has no template."""
    kinds = F.array(*[F.struct(F.lit(t).alias("prompt_type")) for t in prompts.TYPES])
    docs = _read(spark, d, "documents").select("doc_id", "text", "source", "lang", F.get(F.array(*map(F.lit, SET_NAMES)), F.pmod("doc_id", F.lit(6)).cast("int")).alias("dataset"), F.explode(kinds).alias("k")).select("*", "k.*").drop("k")
    choices = F.when(F.pmod("doc_id", F.lit(5)) == 0, F.array(F.lit("en"), F.lit("fr"))).otherwise(F.array(F.lit("en"), F.lit("fr"), F.lit("de"), F.coalesce("lang", F.lit(""))))
    values = prompts.values_of(F.concat_ws(" ", "source", F.lit("{choice_b}")), F.col("text"), choices, F.array(F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))), F.col("lang"), F.col("source"))
    return prompts.render_rows(docs, values, F.size(choices)).select("doc_id", "dataset", "prompt_type", F.md5("prompt").alias("prompt_md5"))


def unstratified_split(spark, d):
    rows = _read(spark, d, "documents").select("doc_id", F.lit("all").alias("_all"))
    return D.stratified_split(rows, "_all", "doc_id").select("doc_id", "split")


def first_samples(spark, d):
    return datasets.first_samples(_samples(spark, d), 20)


def split_statistics(spark, d):
    by = _read(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), "source")
    rows = D.stratified_split(_samples(spark, d).join(by, "sample_id").withColumn("task_type", F.lit("yes_no")), "source", "sample_id")
    found = D.dataset_statistics(rows, "split")
    return found.select("split", "n", F.array_join("task_types", ",").alias("task_types"), "avg_question_length", F.coalesce(F.try_element_at("answer_distribution", F.lit("yes")), F.lit(0).cast("long")).alias("n_yes"))


REFUSED_EVERY = 200


def reply_quarantine(spark, d):
    """Pairs where some prompts of each stage are refused: samples of which a reply failed have the reason in place of pairs."""
    respond = G.refusing_responder(G.canned_responder(), REFUSED_EVERY)
    pairs, failed = training.generate_pairs(spark, _samples(spark, d), stores.scratch(spark, "quarantine"), "critic", 0, respond, rounds=3)
    columns = ("sample_id", "round", "direction", "positive", "negative")
    return pairs.select(*columns, F.round("delta", 9).alias("delta"), F.lit(None).cast("string").alias("error")).unionByName(failed, allowMissingColumns=True)


def resumed_pairs(spark, d):
    """Pairs by batches on a ledger, in two runs: the second has samples that the first had not."""
    root, samples = stores.scratch(spark, "resumed"), _samples(spark, d)
    training.generate_resumably(spark, samples.where("answer = 'yes'"), root, "critic", 0, batches=2, rounds=3)
    return training.generate_resumably(spark, samples, root, "critic", 0, batches=2, rounds=3)[0].select(*_PAIR)


def generated_samples(spark, d):
    """Three draws a prompt over the benchmark's items, cut at a stop string."""
    sampling = G.Sampling(n=3, max_tokens=16, stop=(";", "fits"))
    out = G.generate(_read(spark, d, "benchmark").select("item_id", "text"), F.concat(F.lit("Is this so? "), F.coalesce("text", F.lit(""))), G.CannedModel, sampling, budget=4096)
    return G.samples_of(out.drop("text")).select("item_id", "draw", "text", "error")


def array_roundtrip(spark, d):
    """Pairs as JSON arrays, a file a task, read back by as many tasks as there are bytes."""
    path = stores.scratch(spark, "array")
    stores.write_array(_pairs(spark, d), path, files=None)
    return stores.read_array(spark, path).select(*_PAIR)


OBJECTIVE = dpo.Objective(beta=0.5, nll=0.25, rate=2.0)


def dpo_steps(spark, d):
    """Losses of the actor's policy before and after one step on its preference rows."""
    path = stores.scratch(spark, "dpo")
    dpo.packed(training.preference_rows(_pairs(spark, d)).where("agent = 'actor'")).write.parquet(path)
    rows, reference = spark.read.parquet(path), [0.0] * dpo.BUCKETS
    weights, out = reference, []
    for i in range(2):
        found = dpo.step(rows, weights, reference, OBJECTIVE)
        if found is None:
            break
        out.append((i, found.loss, found.dpo, found.nll, found.preferred))
        weights = [w - OBJECTIVE.rate * g for w, g in zip(weights, found.gradient, strict=True)]
    rounded = [F.round(c, 9).alias(c) for c in ("loss", "dpo", "nll", "preferred")]
    return spark.createDataFrame(out, "step int, loss double, dpo double, nll double, preferred double").select("step", *rounded)


def critic_rewards(spark, d):
    """Rewards where the critic is asked about simulated replies as well, and may refuse."""
    turns = P.deliberate(_samples(spark, d), 2)
    respond = G.refusing_responder(G.canned_responder(), REFUSED_EVERY)
    found = P.rewards(turns, ["sample_id", "round"], 5, respond, critic=True)
    return found.select("sample_id", "round", F.round("reward", 9).alias("reward"), "error")


def arrow_dataset_roundtrip(spark, d):
    """Preference rows as an Arrow data set of each agent, the critic's read back."""
    path = stores.scratch(spark, "datasets")
    stores.write_preferences(training.preference_rows(_pairs(spark, d), 0.1), f"{path}/table")
    arrow.write_by_agent(spark.read.schema(stores.PREFERENCES).parquet(f"{path}/table"), path, stores.AGENTS)
    return arrow.read_dataset(spark, f"{path}/critic").select("sample_id", "round", "chosen", "rejected")


def live_early_stopping(spark, d):
    """Daily averages as metric files, folded by a stream in two runs over one checkpoint."""
    path = stores.scratch(spark, "live")
    day = F.datediff(F.to_date("ts"), F.lit("2000-01-01").cast("date")).cast("long")
    days = _read(spark, d, "events").groupBy(F.col("event_type").alias("phase"), day.alias("step")).agg(F.round(F.avg("value"), 6).alias("a"), F.min("ts").alias("timestamp"))
    rows = days.select("phase", "step", "timestamp", F.create_map(F.lit("a"), F.col("a")).alias("metrics"))
    for part in (0, 1):
        rows.where(F.col("step") % 2 == part).write.mode("append").json(f"{path}/metrics")
        out = metrics.live_early_stop(metrics.metrics_stream(spark, f"{path}/metrics"), "a", 2)
        keep = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")
        out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{path}/out")
    return found.groupBy(F.col("phase").alias("event_type")).agg(F.max_by("ran", F.struct("epoch", "records")).cast("int").alias("ran"))


def trained_agent(spark, d):
    """An agent's phase as a whole: pairs by batches, preference rows, two steps of training; the losses on the way."""
    root = stores.scratch(spark, "agent")
    trainer = dpo.LogLinearTrainer(spark, root, dpo.Objective(OBJECTIVE.beta, OBJECTIVE.nll, OBJECTIVE.rate, steps=2))
    training.train_agent(spark, _samples(spark, d), root, "actor", 0, trainer, "none", batches=1, rounds=3)
    return spark.createDataFrame(list(enumerate(trainer.losses)), "step int, loss double").select("step", F.round("loss", 9).alias("loss"))


class _CountingTrainer:
    """Names a model by its base and the rows that it was trained on."""

    def __init__(self, spark):
        self.spark = spark

    def train(self, agent, preferences, base):
        return f"{base}+{stores.read_preferences(self.spark, preferences, agent).count()}"


def alternated_models(spark, d):
    """Two iterations, the second of which has only pairs of round 2; models are named by what they were trained on."""
    root = stores.scratch(spark, "alternation")
    stores.write_pairs(_pairs(spark, d), f"{root}/all")
    pairs = stores.read_pairs(spark, f"{root}/all")
    pairs_of = lambda models: pairs.where("round = 2") if "+" in models["actor"] else pairs
    out = training.alternate(spark, root, {"actor": "actor", "critic": "critic"}, pairs_of, _CountingTrainer(spark), iterations=2, min_delta=0.1)
    return spark.createDataFrame(sorted(out.models.items()), "agent string, model string")


def whole_experiment(spark, d):
    """From split samples over alternating training to the stored summary of the evaluation."""
    root = stores.scratch(spark, "experiment")
    by = _read(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), "source")
    samples = D.stratified_split(_samples(spark, d).join(by, "sample_id"), "source", "sample_id").drop("source")
    settings = config.Settings(config.DEFAULTS, {"deliberation": {"rounds": 3, "simulations": 2}, "generation": {"batches": 1}, "training": {"patience": 1}})
    experiment.run(spark, samples, root, settings, _CountingTrainer(spark), lambda models: G.canned_responder())
    kinds = "num_samples long, num_failed long, initial_accuracy double, final_accuracy double, flip_statistics struct<wrong_to_correct:long,correct_to_wrong:long>"
    row = spark.read.schema(kinds).json(f"{root}/results/summary")
    return row.select("num_samples", "num_failed", *[F.round(c, 9).alias(c) for c in ("initial_accuracy", "final_accuracy")], "flip_statistics.wrong_to_correct", "flip_statistics.correct_to_wrong")


def early_stopping_fold(spark, d):
    days = _read(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("a"))
    series = days.groupBy("event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "a"))), lambda x: x["a"]).alias("series"))
    return series.select("event_type", P.early_stop_column(F.col("series"), 2).alias("ran"))


def config_resolve(spark, d):
    """Flat settings of each event: defaults under the common ones that are shared, under the step's; nulls and unknown names change nothing."""
    entry = lambda k, v: (F.lit(k), v.cast("long"))
    k = F.from_json("props", "k long")["k"]
    defaults = F.create_map(*entry("seed", F.lit(42)), *entry("rounds", F.lit(5)), *entry("patience", F.lit(0)))
    common = F.create_map(*entry("seed", F.col("user_id")), *entry("patience", k), *entry("unknown", F.lit(1)))
    step = F.create_map(*entry("rounds", F.when(F.col("event_type") == "click", 2)), *entry("seed", F.when(k > 50, k)))
    found = config.resolve_column(defaults, common, step, ("seed",))
    return _read(spark, d, "events").select("event_id", *[F.element_at(found, x).alias(x) for x in ("seed", "rounds", "patience")])


def error_quarantine(spark, d):
    """A row's value, or the reason why it has none."""
    k = F.from_json("props", "k long")["k"]
    error = F.when(k.isNull(), "no k").when(k >= 50, F.concat(F.lit("k out of range: "), k.cast("string")))
    return _read(spark, d, "events").select("event_id", F.when(error.isNull(), k).cast("string").alias("k"), error.alias("error"))


def isolated_task(spark, d):
    """The same through a Python task that raises; its errors are rows."""
    return D.isolate(_read(spark, d, "events").select("event_id", "props"), _parse_props, "event_id long, k long").withColumn("k", F.col("k").cast("string"))


def _parse_props(row):
    found = json.loads(row["props"])["k"]
    if found >= 50:
        raise ValueError("k out of range")
    return {"event_id": row["event_id"], "k": found}


def metric_windows(spark, d):
    rows = _read(spark, d, "events").select(F.col("event_type").alias("phase"), F.col("ts").alias("timestamp"), F.create_map(F.lit("value"), F.col("value")).alias("metrics"))
    return metrics.windowed_metrics(rows, "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "phase", "metric", "n", F.round("mean", 6).alias("mean"))


NAMES = (
    standardize_yes_no, standardize_mc, standardize_mc_struct, extract_yes_no, extract_mc, extract_mixed, normalize_answers, wrong_answer_choice,
    stratified_split, unstratified_split, split_sizes, split_statistics, split_fallback, first_samples, dataset_stats_answers, interleaved_history, chat_transcript,
    detect_model_type, metrics_jsonl_parse, metric_windows, natural_deliberation, choice_deliberation, mixed_deliberation, choice_rewards, guided_round,
    per_round_accuracy, per_round_delta, flip_statistics, sample_details, correct_at_each_round, evaluate_benchmark, rollout_reward,
    preference_pairs, pairs_min_delta, prefs_actor, prefs_critic, pair_cache_roundtrip, pairs_jsonl_roundtrip, preferences_roundtrip, results_roundtrip, metric_log_roundtrip,
    render_prompts_yes_no, render_prompts_choice, render_prompts_alias, render_mixed_datasets,
    load_yes_no, load_tasks, load_lines, named_history, no_simulations, validation_record, trained_agent, alternated_models, whole_experiment,
    standardize_sciq, critic_rewards, arrow_dataset_roundtrip, live_early_stopping, reply_quarantine, resumed_pairs, generated_samples, array_roundtrip, dpo_steps, early_stopping_fold, config_resolve, settings_merge, dataset_tasks, error_quarantine, isolated_task,
)

_S = "SELECT d.doc_id AS sample_id, 'Is document ' || d.doc_id || ' good?' AS question, coalesce(d.text, '') AS passage, CASE WHEN l.quality = 1 THEN 'yes' ELSE 'no' END AS answer FROM documents d JOIN labels l USING (doc_id)"
_SPLIT = "SELECT doc_id, lang, CASE WHEN r <= floor(n * 0.25::DOUBLE) THEN 'test' WHEN r <= floor(n * 0.25::DOUBLE) + floor(n * 0.10::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)"


def _sql_respond(role: str, prompt: str, sim: str = "'0'", replies: tuple[str, ...] = G.CANNED, every: int = 0) -> str:
    """The canned reply; with every, null for prompts that are refused."""
    canned = ", ".join("'" + x.replace("'", "''") + "'" for x in replies)
    if every:
        return f"CASE WHEN ('0x' || substr(md5({prompt}), 7, 6))::BIGINT % {every} <> 0 THEN {_sql_respond(role, prompt, sim, replies)} END"
    return f"([{canned}])[1 + (('0x' || substr(md5('{role}|42|' || {sim} || '|' || {prompt}), 1, 6))::BIGINT % {len(replies)})]"


def _sql_prompt(dataset: str, kind: str, **values: str) -> str:
    """A template with SQL for its names; question, passage and choices are columns."""
    known = {"question": "question", "passage": "passage"} | {f"choice_{x}": f"'{c}'" for x, c in zip("abcd", LANGUAGES, strict=True)} | values
    parts = re.split(r"\{(\w+)\}", prompts.template(dataset, kind))
    return "(" + " || ".join(known[x] if i % 2 else f"'{x}'" for i, x in enumerate(parts)) + ")"


def _sql_person(n: str, said: str) -> str:
    return f"'\nPerson ' || ({n}) || ' said: ' || {said}"


def _sql_turns(rounds: int, dataset: str = "boolq", samples: str = "", replies: tuple[str, ...] = G.CANNED, every: int = 0) -> str:
    reader = {"yes_no": _YES_NO, "multiple_choice": _CHOICE, "mixed": f"coalesce({_CHOICE}, {_YES_NO})"}[prompts.task_type(dataset)]
    sql, previous, history = f"WITH s AS ({samples or _S})", "s", "''"
    for t in range(rounds):
        prompt = _sql_prompt(dataset, "single_shot") if t == 0 else _sql_prompt(dataset, "deliberation", responses_text=f"({history})")
        critic = _sql_prompt(dataset, "critic", actor_response=f"a{t}")
        sql += f", x{t} AS (SELECT *, {prompt} AS p{t}, {_sql_respond('actor', prompt, replies=replies, every=every)} AS a{t} FROM {previous}), y{t} AS (SELECT *, {critic} AS q{t}, {_sql_respond('critic', critic, replies=replies, every=every)} AS c{t} FROM x{t})"
        previous, history = f"y{t}", f"{history} || {_sql_person(str(2 * t + 1), f'a{t}')} || {_sql_person(str(2 * t + 2), f'c{t}')}"
    columns = "sample_id, question, answer" + (", passage" if not samples else "")
    parts = " UNION ALL ".join(f"SELECT {columns}, {t}::INT AS round, p{t} AS actor_prompt, q{t} AS critic_prompt, a{t} AS actor_response, c{t} AS critic_response, {reader.replace('text', f'a{t}')} AS actor_answer FROM y{rounds - 1}" for t in range(rounds))
    seen = f"string_agg({_sql_person('round + 1', 'actor_response')}, '' ORDER BY round) OVER (PARTITION BY sample_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"{sql}, said AS ({parts}), turns AS (SELECT *, coalesce({seen}, '') AS h FROM said), scored AS (SELECT *, CASE WHEN coalesce(left(actor_answer, 1), '') = upper(left(answer, 1)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ok FROM turns) "


def _sql_simulated(source: str, dataset: str = "boolq", replies: tuple[str, ...] = G.CANNED, a: str = "actor_response", c: str = "critic_response", every: int = 0) -> str:
    """Rows of source, which has h, with ok of each of five simulated replies."""
    prompt = _sql_prompt(dataset, "deliberation", responses_text=f"(h || {_sql_person('round + 1', a)} || {_sql_person('round + 2', c)})")
    reader = (_CHOICE if prompts.task_type(dataset) == "multiple_choice" else _YES_NO).replace("text", "reply")
    replied = f"SELECT *, {_sql_respond('actor', prompt, 'sim', replies, every)} AS reply FROM {source}, (SELECT unnest(['1', '2', '3', '4', '5']) AS sim)"
    return f"SELECT *, CASE WHEN coalesce(left({reader}, 1), '') = upper(left(answer, 1)) AND answer <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ok FROM ({replied})"


_CHOICES = "SELECT d.doc_id AS sample_id, coalesce(d.text, '') AS question, CASE lang WHEN 'en' THEN 'A' WHEN 'fr' THEN 'B' WHEN 'de' THEN 'C' WHEN 'es' THEN 'D' END AS answer FROM documents d"


def _sql_first(patterns: tuple[str, ...], text: str = "text") -> str:
    return ", ".join(f"nullif(regexp_extract({text}, '(?i){p}', 1), '')" for p in patterns)


# RE2 has neither lookahead nor Unicode word limits, so these two patterns are written out.
_LAST_WORD = r"(?is)(?:^|.*[^\p{L}\p{N}_])(Yes|No)(?:[^\p{L}\p{N}_]|$)"
_LONE_LETTER = r"(?:^|[^\p{L}\p{N}_])([A-D])(?:[.,;:]?[\s\p{Z}]*$|[\s\p{Z}]+is|[\s\p{Z}]*\.)"
_YES_NO = f"upper(coalesce({_sql_first(A.YES_NO)}, nullif(regexp_extract(text, '{_LAST_WORD}', 1), '')))"
_CHOICE = f"upper(coalesce({_sql_first((*A.CHOICE[:-1], _LONE_LETTER))}))"


def _sql_pairs(late: str = "SELECT * FROM turns WHERE round >= 1", every: int = 0) -> str:
    """Pairs of three rounds, from CTE turns."""
    guided, steered = _sql_prompt("boolq", "guided_deliberation", responses_text="h", target_answer="target"), _sql_prompt("boolq", "guided_critic", actor_response="a", target_answer="target")
    texts = ", ".join(f"max({x}) FILTER (variant = '{v}') AS {v}_{x}" for v in ("natural", "right", "wrong") for x in "ac")
    means = ", ".join(f"avg(ok) FILTER (variant = '{v}') AS {v}_v" for v in ("natural", "right", "wrong"))
    return f""", late AS ({late}),
variants AS (SELECT *, 'natural' AS variant, '' AS target FROM late UNION ALL SELECT *, 'right', answer FROM late UNION ALL SELECT *, 'wrong', CASE answer WHEN 'yes' THEN 'no' ELSE 'yes' END FROM late),
acted AS (SELECT *, CASE variant WHEN 'natural' THEN actor_response ELSE {_sql_respond('actor', guided, every=every)} END AS a FROM variants),
both_said AS (SELECT *, CASE variant WHEN 'natural' THEN critic_response ELSE {_sql_respond('critic', steered, every=every)} END AS c FROM acted),
simulated AS ({_sql_simulated('both_said', a='a', c='c', every=every)}),
wide AS (SELECT sample_id, round, any_value(actor_prompt) AS actor_prompt, any_value(critic_prompt) AS critic_prompt, {texts}, {means} FROM simulated GROUP BY sample_id, round),
pairs AS (SELECT sample_id, actor_prompt, critic_prompt, right_a AS positive, natural_a AS negative, right_c AS positive_critic, natural_c AS negative_critic, round, round(right_v - natural_v, 9) AS delta, 'towards' AS direction FROM wide WHERE right_v - natural_v >= 0
UNION ALL SELECT sample_id, actor_prompt, critic_prompt, natural_a, wrong_a, natural_c, wrong_c, round, round(natural_v - wrong_v, 9), 'away' FROM wide WHERE right_v - natural_v < 0 AND natural_v - wrong_v >= 0) """


def _sql_prompts(dataset: str) -> str:
    values = {"question": "text", "passage": "source", "choice_a": "'en'", "choice_b": "'fr'", "choice_c": "'de'", "choice_d": "lang", "target_answer": "lang", "responses_text": "'\nPerson 1 said: ' || source || '\nPerson 2 said: ' || lang", "actor_response": "source"}
    columns = []
    for t in prompts.TYPES:
        parts = re.split(r"\{(\w+)\}", prompts.template(dataset, t))
        columns.append("md5(" + " || ".join(f"coalesce({values[x]}, '')" if i % 2 else f"'{x}'" for i, x in enumerate(parts)) + f") AS {t}")
    return f"SELECT doc_id, {', '.join(columns)} FROM (SELECT doc_id, text, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM documents)"


def _sql_mixed() -> str:
    """Each set's templates by concatenation; with two choices, names put in one after another."""
    base = {"question": "concat_ws(' ', source, '{choice_b}')", "passage": "coalesce(text, '')", "choice_a": "'en'", "choice_b": "'fr'", "choice_c": "'de'", "choice_d": "coalesce(lang, '')", "target_answer": "coalesce(lang, '')", "responses_text": "'\nPerson 1 said: ' || coalesce(source, '') || '\nPerson 2 said: ' || coalesce(lang, '')", "actor_response": "coalesce(source, '')"}
    cases = []
    for name in SET_NAMES[:-1]:
        for t in prompts.TYPES:
            text = prompts.template(name, t)
            whole = " || ".join(base[x] if i % 2 else f"'{x}'" for i, x in enumerate(re.split(r"\{(\w+)\}", text)))
            put = f"'{text}'"
            for x in prompts.ORDER:
                if x not in ("choice_c", "choice_d"):
                    put = f"replace({put}, '{{{x}}}', {base[x]})"
            two = f"WHEN dataset = '{name}' AND prompt_type = '{t}' AND doc_id % 5 = 0 THEN {put} " if "{choice_a}" in text else ""
            cases.append(f"{two}WHEN dataset = '{name}' AND prompt_type = '{t}' THEN {whole}")
    return f"SELECT doc_id, dataset, prompt_type, md5(CASE {' '.join(cases)} END) AS prompt_md5 FROM (SELECT *, ([{', '.join(repr(x) for x in SET_NAMES)}])[1 + doc_id % 6] AS dataset, unnest([{', '.join(repr(x) for x in prompts.TYPES)}]) AS prompt_type FROM documents)"


def _sql_critic() -> str:
    """Simulated replies as usual, then the critic's on each; a state's least error leaves it without a reward."""
    feedback = _sql_prompt("boolq", "critic", actor_response="reply")
    said = f"SELECT *, {_sql_respond('critic', feedback, 'sim', every=REFUSED_EVERY)} AS feedback FROM ({_sql_simulated('turns', every=REFUSED_EVERY)})"
    error = "min(CASE WHEN reply IS NULL THEN 'round ' || round || ' simulated actor: refused' WHEN feedback IS NULL THEN 'round ' || round || ' simulated critic: refused' END)"
    return _sql_turns(2) + f"SELECT sample_id, round, CASE WHEN {error} IS NULL THEN round(avg(ok), 9) END AS reward, {error} AS error FROM ({said}) GROUP BY sample_id, round"


def _sql_quarantine() -> str:
    """A sample's first failed turn, else the least of its later errors; pairs of samples without."""
    n = REFUSED_EVERY
    first = "arg_min(CASE WHEN actor_response IS NULL THEN 'round ' || round || ' actor: refused' ELSE 'round ' || round || ' critic: refused' END, round) FILTER (actor_response IS NULL OR critic_response IS NULL)"
    late = "SELECT turns.* FROM turns JOIN bad USING (sample_id) WHERE round >= 1 AND error IS NULL"
    said = _sql_turns(3, every=n) + f", bad AS (SELECT sample_id, {first} AS error FROM turns GROUP BY sample_id)" + _sql_pairs(late, n)
    later = "CASE WHEN a IS NULL THEN 'round ' || round || ' guided actor: refused' WHEN c IS NULL THEN 'round ' || round || ' guided critic: refused' WHEN reply IS NULL THEN 'round ' || round || ' simulated actor: refused' END"
    return said + f""", worse AS (SELECT sample_id, min({later}) AS error FROM simulated GROUP BY sample_id),
gone AS (SELECT sample_id, coalesce(bad.error, worse.error) AS error FROM bad LEFT JOIN worse USING (sample_id) WHERE coalesce(bad.error, worse.error) IS NOT NULL)
SELECT sample_id, round, direction, positive, negative, delta, NULL::VARCHAR AS error FROM pairs WHERE sample_id NOT IN (SELECT sample_id FROM gone)
UNION ALL SELECT sample_id, NULL::INT, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::DOUBLE, error FROM gone"""


def _sql_dpo(pairs: str) -> str:
    """Loss at equal weights, the gradient there by bucket, and the loss after one step; buckets without a word share one weight."""
    b, o = f"{dpo.BUCKETS}.0::DOUBLE", OBJECTIVE
    words = lambda c: f"regexp_extract_all(lower(coalesce({c}, '')), '[^\\x20\\x09-\\x0D]+')"
    return f"""{pairs}, p AS (SELECT row_number() OVER () AS i, {words("positive")} AS yes, {words("negative")} AS no FROM pairs),
x AS (SELECT i, len(yes)::DOUBLE AS ny, len(no)::DOUBLE AS nn FROM p), total AS (SELECT count(*)::DOUBLE AS n FROM p),
w AS (SELECT i, unnest(yes) AS word, 1.0::DOUBLE AS y, 0.0::DOUBLE AS o FROM p UNION ALL SELECT i, unnest(no), 0.0::DOUBLE, 1.0::DOUBLE FROM p),
f AS (SELECT i, ('0x' || substr(md5(word), 1, 8))::BIGINT % {dpo.BUCKETS} AS bucket, sum(y) AS y, sum(o) AS o FROM w GROUP BY ALL),
g AS (SELECT bucket, sum(({-o.beta / 2}::DOUBLE) * (y - f.o) - {o.nll}::DOUBLE * y / greatest(ny, 1)) / (SELECT n FROM total) AS g FROM f JOIN x USING (i) GROUP BY bucket),
drawn AS (SELECT sum(g) AS s, count(*) AS seen FROM g),
v AS (SELECT bucket, -{o.rate}::DOUBLE * (g - s / {b}) AS v FROM g, drawn), u AS (SELECT -{o.rate}::DOUBLE * (-s / {b}) AS u, seen FROM drawn),
z AS (SELECT ln((SELECT sum(exp(v)) FROM v) + ({b} - seen) * exp(u)) AS z FROM u),
r AS (SELECT i, sum((y - o) * v) AS d, sum(y * v) AS y FROM f JOIN v USING (bucket) GROUP BY i),
m AS (SELECT x.i, coalesce(d, 0) - (ny - nn) * (z - ln({b})) AS m, (ny * z - coalesce(y, 0)) / greatest(ny, 1) AS nll FROM x LEFT JOIN r USING (i), z),
l AS (SELECT 0::INT AS step, avg(ln(2.0::DOUBLE)) AS dpo, avg(ny * ln({b}) / greatest(ny, 1)) AS nll, 0.0::DOUBLE AS preferred FROM x UNION ALL SELECT 1::INT, avg(ln(1 + exp(-{o.beta}::DOUBLE * m))), avg(nll), avg((m > 0)::INT::DOUBLE) FROM m)
SELECT step, round(dpo + {o.nll}::DOUBLE * nll, 9) AS loss, round(dpo, 9) AS dpo, round(nll, 9) AS nll, round(preferred, 9) AS preferred FROM l"""


_STOP = """WITH RECURSIVE days AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, a FROM (SELECT event_type, ts::DATE AS day, round(avg(value), 6) AS a FROM events GROUP BY ALL)),
f AS (SELECT event_type, 0::BIGINT AS i, '-infinity'::DOUBLE AS best, 0 AS waited, 0 AS ran FROM (SELECT DISTINCT event_type FROM days)
UNION ALL SELECT f.event_type, d.i, CASE WHEN d.a > best THEN d.a ELSE best END, CASE WHEN d.a > best THEN 0 ELSE waited + 1 END, ran + 1 FROM f JOIN days d ON d.event_type = f.event_type AND d.i = f.i + 1 WHERE waited < 2)
SELECT event_type, max(ran) AS ran FROM f GROUP BY event_type"""


def oracle_sql() -> dict[str, str]:
    z = 1.959963984540054
    # a letter is none of the choices' texts, so one of all four is drawn: that of random.Random(42).choice
    wrong = "CASE WHEN answer IS NOT NULL THEN 'EN' END"
    argued = f"CASE WHEN round = 0 THEN {_sql_prompt('mmlu', 'guided_single_shot', target_answer='target')} ELSE {_sql_prompt('mmlu', 'guided_deliberation', responses_text='h', target_answer='target')} END"
    steered = _sql_prompt("mmlu", "guided_critic", actor_response="a", target_answer="target")
    pairs = _sql_turns(3) + _sql_pairs()
    tested = _SPLIT.replace("doc_id, lang", "sample_id, question, passage, answer").replace("PARTITION BY lang", "PARTITION BY source").replace("doc_id", "sample_id").replace("FROM documents)", f"FROM (SELECT s.*, d.source FROM ({_S}) s JOIN documents d ON d.doc_id = s.sample_id))")
    tested = f"SELECT * FROM ({tested}) WHERE split = 'test'"
    prompted = "'Is this so? ' || coalesce(text, '')"
    return {
        "standardize_yes_no": _S,
        "standardize_mc": "SELECT doc_id, CASE lang WHEN 'en' THEN 'A' WHEN 'fr' THEN 'B' WHEN 'de' THEN 'C' WHEN 'es' THEN 'D' END AS answer, 'A,B,C,D' AS labels FROM documents",
        "extract_yes_no": f"SELECT conv_id, turn, {_YES_NO} AS answer FROM conversations",
        "extract_mc": f"SELECT conv_id, turn, {_CHOICE} AS answer FROM conversations",
        "extract_mixed": f"SELECT doc_id, coalesce({_CHOICE}, {_YES_NO}) AS answer FROM documents",
        "interleaved_history": r"""WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r FROM conversations WHERE role <> 'system'),
g AS (SELECT conv_id, (r // 2)::INT AS round, max(text) FILTER (r % 2 = 0) AS actor, max(text) FILTER (r % 2 = 1) AS critic FROM t GROUP BY ALL)
SELECT conv_id, round, 2 * count(*) OVER w AS n_history, md5(coalesce(string_agg(chr(10) || 'Person ' || (2 * round + 1) || ' said: ' || coalesce(actor, '') || chr(10) || 'Person ' || (2 * round + 2) || ' said: ' || coalesce(critic, ''), '') OVER w, '')) AS history_md5, count(actor) OVER w AS n_actor
FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
        "unstratified_split": _SPLIT.replace("PARTITION BY lang ", "").replace("PARTITION BY lang", "").replace("doc_id, lang", "doc_id"),
        "first_samples": f"SELECT * FROM ({_S}) ORDER BY sample_id LIMIT 20",
        "split_statistics": f"SELECT split, count(*) AS n, 'yes_no' AS task_types, round(avg(len(string_split(question, ' '))), 1) AS avg_question_length, count(*) FILTER (answer = 'yes') AS n_yes FROM (SELECT *, CASE WHEN r <= floor(n * 0.25::DOUBLE) THEN 'test' WHEN r <= floor(n * 0.25::DOUBLE) + floor(n * 0.10::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || sample_id), sample_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM (SELECT s.*, d.source FROM ({_S}) s JOIN documents d ON d.doc_id = sample_id))) GROUP BY split",
        "sample_details": _sql_turns(3) + "SELECT *, initial_answer = trim(upper(label)) AS initial_correct, final_answer = trim(upper(label)) AS final_correct, initial_answer <> upper(label) AND final_answer = upper(label) AS flipped_to_correct, initial_answer = upper(label) AND final_answer <> upper(label) AS flipped_to_wrong FROM (SELECT sample_id, arg_min(coalesce(actor_answer, ''), round) AS initial_answer, arg_max(coalesce(actor_answer, ''), round) AS final_answer, any_value(answer) AS label FROM turns GROUP BY sample_id)",
        "correct_at_each_round": _sql_turns(3) + "SELECT round, count(*) FILTER (actor_answer = upper(answer)) AS correct FROM turns GROUP BY round",
        "evaluate_benchmark": _sql_turns(3) + f"""SELECT n AS num_samples, round(a0, 9) AS initial_accuracy, round(a2, 9) AS final_accuracy, round(m, 9) AS margin, round(greatest(0, a2 - m), 9) AS ci_low, round(least(1, a2 + m), 9) AS ci_high, round(CASE WHEN a0 = 0 THEN 0 ELSE (a2 - a0) / a0 END, 9) AS improvement_rate, round(a2 - a0, 9) AS absolute_gain, round(a2 - a1, 9) AS last_delta, wc AS wrong_to_correct, cw AS correct_to_wrong
FROM (SELECT *, {z} * sqrt(a2 * (1 - a2) / n + {z * z} / (4.0 * n * n)) / (1 + {z * z} / n) AS m FROM (SELECT count(*) FILTER (round = 0) AS n, avg(ok) FILTER (round = 0) AS a0, avg(ok) FILTER (round = 1) AS a1, avg(ok) FILTER (round = 2) AS a2 FROM scored)),
(SELECT count(*) FILTER (i = 0 AND f = 1) AS wc, count(*) FILTER (i = 1 AND f = 0) AS cw FROM (SELECT arg_min(ok, round) AS i, arg_max(ok, round) AS f FROM scored GROUP BY sample_id))""",
        "preference_pairs": _sql_turns(3) + _sql_pairs() + "SELECT * FROM pairs",
        "pairs_min_delta": _sql_turns(3) + _sql_pairs() + "SELECT sample_id, round, delta, direction FROM pairs WHERE delta >= 0.1",
        "prefs_actor": _sql_turns(3) + _sql_pairs() + "SELECT sample_id, actor_prompt AS prompt, positive AS chosen, negative AS rejected, round, delta, direction FROM pairs",
        "prefs_critic": _sql_turns(3) + _sql_pairs() + "SELECT sample_id, critic_prompt AS prompt, positive_critic AS chosen, negative_critic AS rejected, round, delta, direction FROM pairs",
        "render_prompts_yes_no": _sql_prompts("boolq"),
        "render_prompts_choice": _sql_prompts("mmlu"),
        "early_stopping_fold": _STOP,
        "config_resolve": "SELECT event_id, coalesce(CASE WHEN k > 50 THEN k END, user_id, 42)::BIGINT AS seed, CASE WHEN event_type = 'click' THEN 2 ELSE 5 END::BIGINT AS rounds, 0::BIGINT AS patience FROM (SELECT *, (props::JSON->>'k')::BIGINT AS k FROM events)",
        "render_mixed_datasets": _sql_mixed(),
        "load_yes_no": "SELECT doc_id AS sample_id, (['train', 'validation', 'test'])[1 + doc_id % 4] AS split, coalesce(source, '') AS question, coalesce(lang, '') AS passage, CASE WHEN doc_id % 3 = 0 THEN 'yes' ELSE 'no' END AS answer, 'Yes,No' AS choices, 'yes_no' AS task_type FROM documents WHERE doc_id % 4 <> 3",
        "load_tasks": f"SELECT doc_id AS sample_id, coalesce(s.lang, 'none') AS bbh_task, split, coalesce(md5(text), '') AS question, coalesce(source, '') AS answer, 'mixed' AS task_type FROM ({_SPLIT}) s JOIN documents d USING (doc_id)",
        "load_lines": "SELECT CASE i WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split, 'mixed' AS task_type, k AS n, k AS empty FROM (SELECT i, CASE i WHEN 0 THEN floor(n * 0.25::DOUBLE) WHEN 1 THEN floor(n * 0.10::DOUBLE) ELSE n - floor(n * 0.25::DOUBLE) - floor(n * 0.10::DOUBLE) END::BIGINT AS k FROM (SELECT count(*) AS n FROM documents), (SELECT unnest([0, 1, 2]) AS i)) WHERE k > 0",
        "named_history": "SELECT conv_id, md5(string_agg(chr(10) || 'Person ' || role || ' said: ' || text, '' ORDER BY role)) AS history_md5 FROM (SELECT conv_id, role, coalesce(arg_max(coalesce(text, ''), turn), '') AS text FROM conversations GROUP BY conv_id, role) GROUP BY conv_id",
        "no_simulations": f"SELECT sample_id, round, 0.0::DOUBLE AS reward FROM ({_S}), (SELECT unnest([0, 1])::INT AS round)",
        "validation_record": _sql_turns(3) + f"SELECT 3::INT AS iteration, round(a2, 9) AS val_accuracy, round({z} * sqrt(a2 * (1 - a2) / n + {z * z} / (4.0 * n * n)) / (1 + {z * z} / n), 9) AS val_ci_margin, round(CASE WHEN a0 = 0 THEN 0 ELSE (a2 - a0) / a0 END, 9) AS improvement_rate FROM (SELECT count(*) FILTER (round = 0) AS n, avg(ok) FILTER (round = 0) AS a0, avg(ok) FILTER (round = 2) AS a2 FROM scored)",
        "trained_agent": f"SELECT step, loss FROM ({_sql_dpo(pairs)})",
        "alternated_models": f"{pairs} SELECT agent, agent || '+' || count(*) || '+' || count(*) FILTER (round = 2) AS model FROM pairs, (SELECT unnest(['actor', 'critic']) AS agent) WHERE delta >= 0.1 GROUP BY agent",
        "whole_experiment": _sql_turns(3, samples=tested) + "SELECT count(*) FILTER (round = 0) AS num_samples, 0::BIGINT AS num_failed, round(avg(ok) FILTER (round = 0), 9) AS initial_accuracy, round(avg(ok) FILTER (round = 2), 9) AS final_accuracy, (SELECT count(*) FILTER (i = 0 AND f = 1) FROM ends) AS wrong_to_correct, (SELECT count(*) FILTER (i = 1 AND f = 0) FROM ends) AS correct_to_wrong FROM scored".replace("SELECT count", ", ends AS (SELECT arg_min(ok, round) AS i, arg_max(ok, round) AS f FROM scored GROUP BY sample_id) SELECT count", 1),
        "standardize_sciq": "SELECT doc_id AS sample_id, md5(coalesce(text, '')) AS passage_md5, chr(64 + list_position(c, lang)) AS answer, array_to_string(c, ',') AS choices FROM (SELECT *, list_transform(list_sort(list_transform(['en', 'fr', 'de', 'es'], lambda x: md5('42|' || doc_id || '|' || x) || x)), lambda x: substr(x, 33)) AS c FROM documents)",
        "critic_rewards": _sql_critic(),
        "arrow_dataset_roundtrip": f"{pairs} SELECT sample_id, round, positive_critic AS chosen, negative_critic AS rejected FROM pairs WHERE delta >= 0.1",
        "live_early_stopping": _STOP,
        "reply_quarantine": _sql_quarantine(),
        "resumed_pairs": f"{pairs} SELECT sample_id, round, direction, positive, negative FROM pairs",
        "array_roundtrip": f"{pairs} SELECT sample_id, round, direction, positive, negative FROM pairs",
        "generated_samples": f"SELECT item_id, draw, string_split(string_split({_sql_respond('actor', prompted, 'draw::VARCHAR')}, ';')[1], 'fits')[1] AS text, NULL::VARCHAR AS error FROM benchmark, (SELECT unnest([0, 1, 2])::INT AS draw)",
        "dpo_steps": _sql_dpo(pairs),
        "error_quarantine": "SELECT event_id, CASE WHEN k < 50 THEN k END::VARCHAR AS k, CASE WHEN k IS NULL THEN 'no k' WHEN k >= 50 THEN 'k out of range: ' || k END AS error FROM (SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events)",
        "metric_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS phase, 'value' AS metric, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
        "normalize_answers": "SELECT o_orderkey, upper(substr(trim(o_orderpriority), 1, 1)) AS answer FROM orders",
        "wrong_answer_choice": "SELECT doc_id, CASE lang WHEN 'en' THEN 'ES' WHEN 'fr' THEN 'ES' WHEN 'de' THEN 'ES' WHEN 'es' THEN 'DE' END AS wrong FROM documents",
        "stratified_split": _SPLIT,
        "split_sizes": f"SELECT lang, split, count(*) AS n FROM ({_SPLIT}) GROUP BY ALL",
        "dataset_stats_answers": f"SELECT answer, count(*) AS n, round(count(*) / (sum(count(*)) OVER ()), 9) AS ratio FROM ({_S}) GROUP BY answer",
        "chat_transcript": "SELECT conv_id, string_agg(upper(substr(role, 1, 1)) || lower(substr(role, 2)) || ': ' || coalesce(text, ''), '\n' ORDER BY turn) || '\nAssistant:' AS transcript FROM conversations GROUP BY conv_id",
        "detect_model_type": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'mistral' WHEN 1 THEN 'gemma' WHEN 2 THEN 'qwen' ELSE 'llama3' END AS model_type FROM part",
        "metrics_jsonl_parse": "SELECT event_type, sum((props::JSON->>'k')::BIGINT)::BIGINT AS sum_k, count((props::JSON->>'k')) AS n FROM events GROUP BY event_type",
        "natural_deliberation": _sql_turns(3) + "SELECT sample_id, round, actor_response, critic_response, actor_answer FROM turns",
        "per_round_accuracy": _sql_turns(3) + f"SELECT round, n, round(a, 9) AS accuracy, round({z} * sqrt(a * (1 - a) / n + {z * z} / (4.0 * n * n)) / (1 + {z * z} / n), 9) AS margin FROM (SELECT round, count(*) AS n, avg(ok) AS a FROM scored GROUP BY round)",
        "per_round_delta": _sql_turns(3) + "SELECT round, delta FROM (SELECT round, round(a - lag(a) OVER (ORDER BY round), 9) AS delta FROM (SELECT round, avg(ok) AS a FROM scored GROUP BY round)) WHERE delta IS NOT NULL",
        "flip_statistics": _sql_turns(3) + "SELECT " + ", ".join(f"count(*) FILTER (i = {i} AND f = {f}) AS n_{i}{f}" for i in (0, 1) for f in (0, 1)) + " FROM (SELECT (arg_min(coalesce(actor_answer, ''), round) = upper(any_value(answer)))::INT AS i, (arg_max(coalesce(actor_answer, ''), round) = upper(any_value(answer)))::INT AS f FROM turns GROUP BY sample_id)",
        "rollout_reward": _sql_turns(3) + f"SELECT sample_id, round, round(avg(ok), 9) AS reward FROM ({_sql_simulated('turns')}) GROUP BY sample_id, round",
        "choice_deliberation": _sql_turns(2, "mmlu", _CHOICES, G.CANNED_CHOICE) + "SELECT sample_id, round, actor_response, critic_response, actor_answer FROM turns",
        "mixed_deliberation": _sql_turns(2, "bbh", _CHOICES, G.CANNED + G.CANNED_CHOICE) + "SELECT sample_id, round, actor_response, actor_answer FROM turns",
        "choice_rewards": _sql_turns(2, "mmlu", _CHOICES, G.CANNED_CHOICE) + f"SELECT sample_id, round, round(avg(ok), 9) AS reward FROM ({_sql_simulated('turns', 'mmlu', G.CANNED_CHOICE)}) GROUP BY sample_id, round",
        "guided_round": _sql_turns(2, "mmlu", _CHOICES, G.CANNED_CHOICE) + f"SELECT sample_id, round, target, a AS actor_response, {_sql_respond('critic', steered, replies=G.CANNED_CHOICE)} AS critic_response FROM (SELECT *, {_sql_respond('actor', argued, replies=G.CANNED_CHOICE)} AS a FROM (SELECT *, {wrong} AS target FROM turns))",
        "pair_cache_roundtrip": f"{pairs} SELECT sample_id, round, direction, positive, negative FROM pairs",
        "pairs_jsonl_roundtrip": f"{pairs} SELECT sample_id, round, direction, positive, negative FROM pairs",
        "preferences_roundtrip": f"{pairs} SELECT sample_id, round, positive_critic AS chosen, negative_critic AS rejected FROM pairs WHERE delta >= 0.1",
        "results_roundtrip": _sql_turns(3) + "SELECT max(n) AS num_samples, round(arg_max(a, round), 9) AS final_accuracy, string_agg(c::VARCHAR, ',' ORDER BY round) AS correct FROM (SELECT round, count(*) AS n, avg(ok) AS a, count(*) FILTER (actor_answer = upper(answer)) AS c FROM scored GROUP BY round)",
        "metric_log_roundtrip": _sql_turns(3) + ", m AS (SELECT round, avg(ok) AS a FROM scored GROUP BY round) SELECT 'eval' AS phase, round::BIGINT AS step, 'accuracy' AS metric, round(a, 9) AS value FROM m UNION ALL SELECT 'eval', round::BIGINT, 'error', round(1 - a, 9) FROM m",
        "standardize_mc_struct": "SELECT doc_id AS sample_id, coalesce(length(text), 0) AS n_question, coalesce(upper(left(lang, 1)), '') AS answer, 'en,fr,de,es' AS choices, CASE WHEN doc_id % 2 = 0 THEN '1,2,3,4' ELSE 'A,B,C,D' END AS labels, 'multiple_choice' AS task_type FROM documents",
        "split_fallback": f"SELECT * FROM ({_SPLIT}) WHERE split = 'validation'",
        "settings_merge": "SELECT user_id, event_type AS name, arg_max(v, (ts, event_id)) AS value, count(*) AS layers FROM (SELECT *, (props::JSON->>'k')::BIGINT % 7 AS v FROM events) WHERE v <> 0 GROUP BY user_id, event_type",
        "dataset_tasks": "SELECT dataset, CASE dataset WHEN 'boolq' THEN 'yes_no' WHEN 'bbh' THEN 'mixed' WHEN 'none' THEN 'unknown' ELSE 'multiple_choice' END AS task_type, dataset <> 'none' AS known, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT doc_id, (['arc', 'bbh', 'boolq', 'mmlu', 'sciq', 'none'])[1 + doc_id % 6] AS dataset FROM documents) GROUP BY dataset",
        "render_prompts_alias": f"SELECT dataset, doc_id, single_shot, critic FROM ({_sql_prompts('mmlu')}), (SELECT unnest(['arc', 'bbh', 'sciq']) AS dataset)",
        "isolated_task": "SELECT event_id, CASE WHEN k < 50 THEN k END::VARCHAR AS k, CASE WHEN k >= 50 THEN 'ValueError: k out of range' END AS error FROM (SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events)",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in NAMES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_round_accuracy(spark, sf_dir)
