"""User-level jobs: compositions of the operators into lazy plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions.text import problem_key
from ..operators import evaluate as EV
from ..operators import rewards as R
from ..operators import votes as V
from ..session import written


def score_rollouts(attempts: DataFrame, problems: DataFrame, key: str = "problem_id") -> DataFrame:
    """attempts x problems -> reward (E2), correctness, advantage (E4) and the
    zero-variance flag.  Gold facts are computed per problem and response facts per row
    before the join, so no text is shuffled (join back on
    (problem, attempt) when the text is needed).  The scored rows are written once: the group
    statistics and the join with them would each read and score all texts."""
    facts = R.response_facts(attempts).drop("response")
    scored = R.reward_from_facts(facts.join(R.gold_facts(problems, key), key, "left"))
    return R.group_advantage(written(scored.drop("gold_numbers"), "scored-rollouts"), key, "reward")


def rollout_report(attempts: DataFrame, problems: DataFrame, key: str = "problem_id",
                   rollouts: int = 8) -> DataFrame:
    """Flagship: per problem accuracy (G12), tier (C7), reward mean/std,
    zero-variance flag (E5), majority answer and confidence (G1/G2).

    One pass: the scored rollouts are pre-aggregated per (problem, answer)
    (partial aggregation before the only data-sized shuffle); the problem
    statistics combine those partials and the vote picks from the same small
    table (``max_by`` in the same aggregate), so the extraction work runs once,
    the plan is a single chain and a hot problem is reduced map-side."""
    facts = R.response_facts(attempts).withColumn("answer", A.boxed_int_scan(F.col("response"))).drop("response")
    scored = R.reward_from_facts(facts.join(R.gold_facts(problems, key), key, "left"))
    r = F.col("reward")
    part = scored.groupBy(key, "answer").agg(
        F.count("*").alias("_n"), F.sum(r).alias("_s"), F.sum(r * r).alias("_ss"),
        F.min(r).alias("_mn"), F.max(r).alias("_mx"), F.sum(F.col("correct").cast("int")).alias("_c"))
    n, s_, ss = F.sum("_n"), F.sum("_s"), F.sum("_ss")
    var = (ss - s_ * s_ / n) / (n - 1)
    per = part.groupBy(key).agg(
        n.alias("n_attempts"), F.sum("_c").cast("bigint").alias("n_correct"),
        F.round(s_ / n, 6).alias("reward_mean"),
        F.round(F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0)))), 6).alias("reward_std"),
        (F.min("_mn") == F.max("_mx")).alias("zero_variance"),
        F.sum(F.when(F.col("answer").isNotNull(), F.col("_n"))).alias("_valid"),
        # the vote from the same partials: largest count, then smallest answer
        F.max_by("answer", F.when(F.col("answer").isNotNull(), F.struct(F.col("_n"), -F.col("answer")))).alias("majority_answer"),
        F.max(F.when(F.col("answer").isNotNull(), F.col("_n"))).alias("winner_votes"))
    acc = F.col("n_correct").cast("double") / F.lit(float(rollouts))
    per = per.withColumn("accuracy", F.round(acc, 6)).withColumn("tier", EV.curriculum_tier(acc))
    return per.select(
        key, "n_attempts", "n_correct", "reward_mean", "reward_std", "zero_variance", "accuracy", "tier",
        "majority_answer", F.coalesce("winner_votes", F.lit(0)).cast("bigint").alias("winner_votes"),
        F.coalesce("_valid", F.lit(0)).cast("bigint").alias("valid_votes"),
        F.coalesce(F.round(F.col("winner_votes") / F.col("_valid"), 6), F.lit(0.0)).alias("confidence"))


def curate_sft(meta: DataFrame, messages: DataFrame, key: str = "conv_id",
               max_acc: float = 0.5, answer_policy: str = "strict") -> DataFrame:
    """v4 curation: hard (0 < acc < max) and integer-answer trajectories,
    compressed to two turns, shortest (words) per problem key (ties: uuid),
    tiered.  Filters run on the narrow header table first; only surviving
    conversations' messages are shuffled; dedup ranks narrow rows and the
    compressed text joins back on the conversation id."""
    from ..functions.text import problem_key, word_count
    from ..operators import curate as C
    from ..operators import filters as B
    m = meta.where(B.is_hard(F.col("accuracy"), max_acc) &
                   B.answer_in_range(F.col("expected_answer"), answer_policy))
    msgs = messages.join(m.select(key), key, "left_semi")
    comp = C.compress_messages(msgs, "v4", key)
    comp = comp.withColumn("n_words", word_count(F.col("assistant"))) \
               .withColumn("problem_key", problem_key(F.col("prompt")))
    j = comp.join(m, key)
    best = C.best_per_problem(j, F.col("problem_key"), [F.col("n_words")], "uuid", key)
    out = j.join(best, key, "left_semi")
    return out.withColumn("tier", EV.curriculum_tier(F.col("accuracy")))


def raft_stages(meta: DataFrame, messages: DataFrame, key: str = "conv_id",
                threshold: float = 0.5) -> DataFrame:
    """Stage 1 = hard (acc < t, zero included, missing -> not hard) with
    tools defined and tool use, shortest trajectory (chars) per problem;
    stage 2 = the same restricted to the aops source.  One pass: a trajectory emits a row for each stage
    it qualifies for, and ``row_number`` picks per (stage, problem).  Trajectories without a user
    turn have no problem and are left out."""
    from ..operators import curate as C
    from ..operators import filters as B
    m = meta.where(B.is_hard(F.col("accuracy"), threshold, exclude_zero=False, missing=1.0) &
                   B.has_tools_defined(F.col("n_tools")))
    facts = messages.join(m.select(key), key, "left_semi").groupBy(key).agg(
        F.max(B.message_uses_tool(F.col("role"), F.col("text"))).alias("_tool"),
        F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("traj_chars"),
        F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("problem"))
    base = m.join(facts.where("_tool and problem is not null").drop("_tool"), key)
    second = B.by_source(F.col("data_source"), "aops", lower=True)
    staged = base.withColumn("stage", F.explode(F.when(second, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    w = Window.partitionBy("stage", problem_key(F.col("problem"))).orderBy("traj_chars", "uuid")
    return staged.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def mine_pairs(attempts: DataFrame, problems: DataFrame, scores: DataFrame | None = None,
               policy: str = "two_way", key: str = "problem_id") -> tuple[DataFrame, DataFrame]:
    """``mine_pairs``: preference pairs under one policy (vs_gold / two_way /
    by_score) and their outcome counters (E10)."""
    from ..operators import pairs as P
    if policy == "vs_gold":
        pairs = P.pairs_vs_gold(attempts, problems, key)
    elif policy == "two_way":
        pairs = P.pairs_two_way(attempts, problems, scores, key)
    elif policy == "by_score":
        pairs = P.pairs_by_score(attempts, problems, scores, key)
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return pairs.where(F.col("outcome") == "pair"), P.pair_stats(pairs)


def vote_and_evaluate(attempts: DataFrame, key: str = "problem_id", response: str = "response",
                      gold: str = "gold") -> dict[str, DataFrame]:
    """``vote`` / ``evaluate``: integer answers (D4) -> majority vote with
    confidence (G1/G2), entropy-weighted vote (G3), accuracy of the majority
    against the gold (G9) and the confidence bands (G11)."""
    a = attempts.withColumn("answer", A.boxed_int_scan(F.col(response)))
    maj = V.majority_vote(a, key, "answer")
    g = attempts.select(key, F.col(gold).cast("bigint").alias("_gold")).dropDuplicates([key])
    judged = maj.join(g, key).withColumn("correct", F.coalesce(F.col("majority_answer") == F.col("_gold"), F.lit(False)))
    out = {"majority": maj, "accuracy": EV.accuracy(judged, "correct", "_gold"),
           "bands": EV.confidence_breakdown(judged)}
    if "entropy" in attempts.columns:
        out["entropy_vote"] = V.entropy_vote(a, "entropy", key=key)
    return out


def profile_corpus(df: DataFrame, text: str, source: str | None = None, acc: str | None = None) -> dict[str, DataFrame]:
    """``profile_corpus``: the one-pass profile tables of a corpus."""
    from ..functions.text import word_count
    from ..operators import profile as PR
    out = {"quality": PR.quality_flags(df, text), "content": PR.content_flags(df, text),
           "length_buckets": PR.length_buckets(df, text, "words"),
           "domains": df.groupBy(PR.classify_domain(F.col(text)).alias("domain")).agg(F.count("*").alias("n"))}
    words = df.select(word_count(F.col(text)).alias("words"))
    out["word_quantiles"] = PR.quantile_index(words, "words", [(1, 2), (9, 10)])
    if source:
        out["sources"] = PR.value_share(df, source)
    if acc:
        out["accuracy"] = PR.accuracy_hist(df, acc)
        out["difficulty"] = df.groupBy(PR.difficulty_bucket(F.col(acc)).alias("bucket")).agg(F.count("*").alias("n"))
    return out


def stream_votes(spark, sf_dir: str, k: int = 4, run: str | None = None) -> dict[str, DataFrame]:
    """``stream_votes``: run the running-vote and early-stop streams to
    completion; returns their tables.  A ``run`` that is named goes on from its checkpoint,
    an unnamed one starts anew."""
    import uuid

    from ..streaming import votes as ST
    run = run or uuid.uuid4().hex
    return {"running_vote": ST.running_votes(ST.run_running_vote(spark, ST.read_event_stream(spark, sf_dir), f"running_vote_{run}")),
            "early_stop": ST.run_early_stop(spark, ST.read_event_stream(spark, sf_dir), k, f"early_stop_{run}")}


def similar_problems(queries: DataFrame, corpus: DataFrame, k: int = 5, partition: str | None = None) -> DataFrame:
    """``similar_problems``: exact top-k neighbours (K1/K2)."""
    from ..operators import retrieval as K
    return K.topk_similar(queries, corpus, k=k, partition=partition)
