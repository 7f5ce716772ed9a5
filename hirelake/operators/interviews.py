"""Interview questions, answer scores, session evaluations and their blend into matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import in_order, round4, uuid5, word_count

#: Words that count as technical in an answer.
TECH_TERMS = (
    "python fastapi api database sql algorithm data system design architecture framework library function class object method variable loop "
    "condition error exception testing deploy server client request response model train inference pipeline workflow implementation "
    "optimization performance security scalable"
).split()
ANSWER_BANDS = (("excellent", 0.85), ("good", 0.65), ("average", 0.45))
SESSION_BANDS = ((0.8, "excellent"), (0.6, "good"), (0.4, "average"))
LEVELS = {"junior": 0, "mid": 1, "senior": 2}
CV_SHARE, INTERVIEW_SHARE = 0.65, 0.35
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
#: Fixed value: what an answer says to its evaluator.
INJECTION = (
    r"(?i)(?:ignore\s+(?:all\s+)?(?:previous|above|prior|system|developer)?\s*instructions|give\s+me\s+(?:100|100/100|full\s+marks?|a\s+perfect\s+score|score\s+1)|"
    r"reveal\s+(?:the\s+)?(?:system|developer)\s+prompt|jailbreak|act\s+as\s+system)"
)
INJECTED = "Prompt injection attempt ignored"
MOST_WEAKNESSES = 6


def _answer_parts(answer: Column, skill: Column) -> tuple[Column, Column, Column, Column]:
    """Whether an answer is too short, and its shares for length, skill words and technical words."""
    low = F.lower(answer)
    keys = F.size(F.filter(F.array_distinct(F.split(F.lower(F.trim(skill)), "\\s+")), lambda w: low.contains(w)))
    terms = F.size(F.filter(F.array(*[F.lit(t) for t in TECH_TERMS]), lambda t: low.contains(t)))
    short = answer.isNull() | (F.length(F.trim(answer)) < 10)
    return short, F.least(F.lit(0.3), word_count(low) / 100 * 0.3), F.least(F.lit(0.4), keys * 0.2), F.least(F.lit(0.3), terms * 0.05)


def answer_score(answer: Column, skill: Column) -> Column:
    """0.1 for very short answers; else length, skill words, technical words and a base of 0.1, at most 1."""
    short, length, keys, terms = _answer_parts(answer, skill)
    return F.when(short, 0.1).otherwise(round4(F.least(F.lit(1.0), length + keys + terms + 0.1)))


def assess_answers(answers: DataFrame) -> DataFrame:
    """answers (session_id, turn, skill, answer) with score, band, technical_accuracy, completeness, clarity, strengths and weaknesses."""
    short, length, keys, _ = _answer_parts(F.col("answer"), F.col("skill"))
    part = lambda c, low: F.when(short, low).otherwise(round4(F.least(F.lit(1.0), c)))
    none = F.array().cast("array<string>")
    rows = score_answers(answers).withColumns({"technical_accuracy": part(keys + 0.2, 0.1), "completeness": part(length + 0.3, 0.1), "clarity": F.when(short, 0.3).otherwise(0.6)})
    strengths = F.when(~short & (F.col("score") >= 0.5), F.array(F.lit("Good effort"))).otherwise(none)
    weaknesses = F.when(short, F.array(F.lit("Answer too short"))).when(F.col("score") < 0.7, F.array(F.lit("Needs more detail"))).otherwise(none)
    return rows.withColumns({"strengths": strengths, "weaknesses": weaknesses})


def band(score: Column) -> Column:
    out = F.lit("weak")
    for name, at in reversed(ANSWER_BANDS):
        out = F.when(score >= at, name).otherwise(out)
    return out


def score_answers(answers: DataFrame) -> DataFrame:
    """answers (session_id, turn, skill, answer) with score and band."""
    return answers.withColumn("score", answer_score(F.col("answer"), F.col("skill"))).withColumn("band", band(F.col("score")))


def cap_injected(evals: DataFrame) -> DataFrame:
    """evals with flagged: whether the answer talks to its evaluator. Such an answer's score, accuracy and completeness are at most 0.2, its
    clarity 0.5, as far as these columns are there, and its weaknesses tell why."""
    flagged = F.coalesce(F.col("answer").rlike(INJECTION), F.lit(False))
    limits = {c: n for c, n in (("score", 0.2), ("technical_accuracy", 0.2), ("completeness", 0.2), ("clarity", 0.5)) if c in evals.columns}
    out = {"flagged": flagged} | {c: F.when(flagged, F.least(c, F.lit(n))).otherwise(F.col(c)) for c, n in limits.items()}
    if "weaknesses" in evals.columns:
        told = F.slice(F.when(F.array_contains("weaknesses", INJECTED), F.col("weaknesses")).otherwise(F.concat("weaknesses", F.array(F.lit(INJECTED)))), 1, MOST_WEAKNESSES)
        out["weaknesses"] = F.when(flagged, told).otherwise(F.col("weaknesses"))
    return evals.withColumns(out)


def check_answer_order(events: DataFrame, n_questions: int) -> DataFrame:
    """events (session_id, turn, question_pos) with accepted: the nth answer must be to the nth question."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("turn"))
    return events.withColumn("place", place).withColumn("accepted", (F.col("place") == F.col("question_pos")) & (F.col("place") <= n_questions))


def evaluate_sessions(scored: DataFrame) -> DataFrame:
    """Per session: mean score, strengths (mean of a skill >= .7) and weaknesses (< .5), and its band."""
    exact = F.col("score").cast("decimal(10,4)")
    by_skill = scored.groupBy("session_id", "skill").agg(round4(F.avg(exact).cast("double")).alias("mean"))
    named = by_skill.withColumns({"down": -F.col("mean"), "strong": F.when(F.col("mean") >= 0.7, F.col("skill")), "weak": F.when(F.col("mean") < 0.5, F.col("skill"))})
    lists = named.groupBy("session_id").agg(in_order("strong", "down", "skill").alias("strengths"), in_order("weak", "mean", "skill").alias("weaknesses"))
    means = scored.groupBy("session_id").agg(F.count("*").alias("n_answers"), round4(F.avg(exact).cast("double")).alias("overall_score"))
    out = F.lit("below average")
    for at, name in reversed(SESSION_BANDS):
        out = F.when(F.col("overall_score") >= at, name).otherwise(out)
    return means.join(lists, "session_id").withColumn("feedback", out)


def session_status(sessions: DataFrame) -> DataFrame:
    """sessions (session_id, n_questions, n_answers, evaluated) with status."""
    done = F.col("n_answers") >= F.col("n_questions")
    return sessions.withColumn("status", F.when(F.col("evaluated") & done, "evaluated").when(done, "completed").when(F.col("n_answers") > 0, "in_progress").otherwise("pending"))


def next_question(sessions: DataFrame) -> DataFrame:
    """sessions (session_id, questions, n_answers) with answered ids and the next one, null after the last."""
    following = F.try_element_at("questions", (F.col("n_answers") + 1).cast("int"))
    return sessions.select("session_id", F.array_join(F.slice("questions", F.lit(1), F.col("n_answers").cast("int")), ",").alias("answered"), following.alias("next_id"))


def bank_pick(bank: DataFrame, needs: DataFrame, n: int = 2) -> DataFrame:
    """Of bank (skill, pos, level, question): the first n questions within a need's level, else the skill's first n."""
    level = F.coalesce(F.element_at(F.create_map(*[x for k, v in LEVELS.items() for x in (F.lit(k), F.lit(v))]), F.col("seniority")), F.lit(1))
    joined = needs.withColumn("target", level).join(bank, "skill").withColumn("fits", F.col("level") <= F.col("target"))
    each = Window.partitionBy("job_id", "skill")
    some = joined.withColumn("some", F.max("fits").over(each)).where("fits OR NOT some")
    return some.withColumn("rn", F.row_number().over(each.orderBy("pos"))).where(F.col("rn") <= n).select("job_id", "skill", "question", "rn")


def question_id(candidate: Column, job: Column, skill: Column, question: Column) -> Column:
    return uuid5(NAMESPACE_URL, F.concat_ws(":", candidate.cast("string"), job.cast("string"), F.lower(F.trim(skill)), question))


def questions(pairs: DataFrame, needs: DataFrame, evidence: DataFrame, limit: int = 8) -> DataFrame:
    """Questions of (job_id, title, candidate_id): required skills first, grounded in the CV where it has evidence."""
    rows = pairs.join(needs, "job_id").join(evidence, ["candidate_id", "skill"], "left")
    grounded = F.concat(F.lit('You write: "'), F.substring("context", 1, 220), F.lit('". Tell us how "'), "skill", F.lit('" came into it, which choices you had, and how you knew that it worked; we ask for the post "'), "title", F.lit('".'))
    gap = F.concat(F.lit("We need "), "skill", F.lit(" here and did not see it in your CV. Where have you worked with it, if at all?"))
    open_ = F.concat(F.lit("Where would "), "skill", F.lit(" help in the work of a "), "title", F.lit("?"))
    asked = rows.withColumn("question", F.when(F.col("context").isNotNull(), grounded).when(F.col("required"), gap).otherwise(open_))
    order = Window.partitionBy("job_id", "candidate_id").orderBy(F.desc("required"), "pos", "skill")
    tag = F.when(F.col("context").isNotNull(), "grounded").when(F.col("required"), "requirement-gap").otherwise("job-skill")
    out = asked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).withColumn("tag", tag)
    return out.withColumn("question_id", question_id(F.col("candidate_id"), F.col("job_id"), F.col("skill"), F.col("question"))).select("job_id", "candidate_id", "place", "question_id", "skill", "question", "tag")


def followups(evals: DataFrame) -> DataFrame:
    """A next question by rule for each scored answer."""
    weak = F.format_string("Which piece of work shows best what you did with %s?", F.col("skill"))
    strong = F.format_string("What did %s cost you, and what did you gain by it?", F.col("skill"))
    return evals.withColumn("followup", F.when(F.col("score") < 0.5, weak).otherwise(strong))


def blend(matches: DataFrame, sessions: DataFrame, reports: DataFrame) -> DataFrame:
    """Matches of interviewed pairs: 0.65 of the CV score (stored, else the match's, else the report's, else .5) and 0.35 of the interview's."""
    keys = ["job_id", "candidate_id"]
    joined = sessions.join(matches, keys, "left").join(reports.select(*keys, "overall"), keys, "left")
    fresh = F.when(F.coalesce("scoring_model", F.lit("")) != "cv_interview_blend", F.col("score"))
    cv = F.coalesce("cv_match_score", fresh, "overall", F.lit(0.5))
    return joined.select(*keys, round4(cv).alias("cv_score"), round4(CV_SHARE * cv + INTERVIEW_SHARE * F.col("overall_score")).alias("final_score"))


def annotate(job_skills: DataFrame, catalog: DataFrame) -> DataFrame:
    """(job_id, skill, category, hint): what to listen for in answers on a job's skills."""
    hint = F.format_string("Listen for hands-on work with %s.", F.col("skill"))
    return job_skills.select("job_id", "skill").distinct().join(catalog.select("skill", "category"), "skill").select("job_id", "skill", "category", hint.alias("hint"))
