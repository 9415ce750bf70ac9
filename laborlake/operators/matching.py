"""Posting ↔ profile matching, match scores and notification rows.

A posting matches a profile when (a) they share at least two skills (case-insensitive)
or (b) one of the profile's target roles is a substring of the posting title.  Profiles
that list the same skills and roles match the same postings, so matching, overlap, score
and text are worked out once per distinct *signature* (skill set, roles); users come in
where their rows are written (``for_users``).  Neither branch is a cross product:

* Skill branch — a posting's skills stand with the rarest first.  A posting and a signature
  that share two skills share one before the posting's last, so the posting emits its skills
  but the last and joins the signatures' skill lists; a pair is kept at its first shared skill
  only.  The order needs just the ``HOT_SKILLS`` most frequent skills by name (all others come
  before them), so a hot skill is the last one in most sets and no skill row is joined to a
  count.
* Role branch — substring search by length: for each length that a role has, the title's
  substrings of that length are hashed and joined to the roles' hashes.  A bit map of the
  role hashes (``ROLE_BITS`` bits whatever the number of roles) drops most substrings before
  the join.  A pair is kept at the first of the signature's roles that the title holds, and not
  where the skill branch finds it.

Each branch finds a pair once and has the whole posting and what the lists say of the signature at
hand, so pairs are neither shuffled to be made distinct nor joined to anything again; while the
lists are small enough to be handed to every task, postings stay where they are.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlake.functions.lists import csv_list
from laborlake.operators.etl import first_rows

# --- fixed values (must equal the reference for identical results) -------------------
MIN_SKILL_OVERLAP = 2
ROLE_MATCH_TEXT = "(matched on role title)"
NOTIFICATION_KIND = "job_match"
NO_SKILLS_TEXT = "none of the listed skills"
NO_GAPS_TEXT = "none — strong match"
TERM_MIN_LEN, TERM_MAX_LEN = 3, 40
# ---------------------------------------------------------------------------------------

HOT_SKILLS = 256
ROLE_BITS = 1 << 16
WORD = 64


def pending_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles with a non-empty skills text."""
    return profiles.filter(F.col("skills").isNotNull() & (F.col("skills") != ""))


def profile_users(profiles: DataFrame, users: DataFrame) -> DataFrame:
    """Matchable profiles with the user's e-mail (inner join on user_id)."""
    return pending_profiles(profiles).join(users.select("user_id", "email"), "user_id")


def profile_signatures(profiles: DataFrame, users: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, signatures) of the matchable profiles: members (user_id, [email,] sig_id),
    signatures (sig_id, sorted distinct lower skill_set, sorted distinct lower roles)."""
    prof = pending_profiles(profiles) if users is None else profile_users(profiles, users)
    sets = prof.select("user_id", *[c for c in ("email",) if c in prof.columns],
                       F.array_sort(F.array_distinct(csv_list("skills"))).alias("skill_set"),
                       F.array_sort(F.array_distinct(csv_list("target_roles"))).alias("roles"))
    sets = sets.withColumn("sig_id", F.md5(F.to_json(F.struct("skill_set", "roles"))))
    return sets.drop("skill_set", "roles"), sets.select("sig_id", "skill_set", "roles").distinct()


def skill_set(names: str) -> Column:
    """Sorted distinct lower-cased names of a list, blank ones left out; NULL → []."""
    trimmed = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda s: F.lower(F.trim(s)))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda s: s != "")))


def posting_skill_sets(posting_skills: DataFrame) -> DataFrame:
    """(posting_id, posting_skills: sorted distinct lower-cased names)."""
    names = posting_skills.select("posting_id", F.lower(F.trim("skill")).alias("skill")).filter(F.col("skill") != "")
    return names.groupBy("posting_id").agg(F.array_sort(F.collect_set("skill")).alias("posting_skills"))


def frequent_skills(sets: DataFrame, column: str, n: int = HOT_SKILLS) -> list[str]:
    """The ``n`` most frequent skills of the sets, the most frequent last.  Only the order in
    which sets are searched depends on them."""
    counts = sets.select(F.explode(column).alias("skill")).groupBy("skill").agg(F.count(F.lit(1)).alias("n"))
    return [r.skill for r in counts.orderBy(F.desc("n"), "skill").limit(n).collect()][::-1]


def _rarest_first(skills: Column, frequent: list[str]) -> Column:
    places = F.lit(frequent) if frequent else F.array().cast("array<string>")
    ranked = F.array_sort(F.transform(skills, lambda s: F.struct(F.array_position(places, s).alias("place"), s.alias("skill"))))
    return F.transform(ranked, lambda r: r["skill"])


def skill_lists(signatures: DataFrame) -> DataFrame:
    """(skill, sig_id, ours, roles): the inverted lists of the signatures' skills."""
    return signatures.select(F.explode("skill_set").alias("skill"), "sig_id", F.col("skill_set").alias("ours"), "roles")


def by_skill(postings: DataFrame, lists: DataFrame, frequent: list[str]) -> DataFrame:
    """Postings and signatures (sig_id, ours, roles) that share ≥ 2 skills, each pair once."""
    theirs = F.coalesce("posting_skills", F.array().cast("array<string>"))
    ranked = postings.where(F.size(theirs) >= MIN_SKILL_OVERLAP).withColumn("theirs", _rarest_first(theirs, frequent))
    heads = F.slice("theirs", 1, F.size("theirs") - (MIN_SKILL_OVERLAP - 1))
    rows = ranked.select("*", F.posexplode(heads).alias("place", "skill"))
    rows = rows.withColumn("before", F.slice("theirs", 1, F.col("place"))).withColumn("behind", F.slice("theirs", F.col("place") + 2, F.size("theirs")))
    return (rows.join(lists, "skill").where(F.arrays_overlap("behind", "ours") & ~F.arrays_overlap("before", "ours"))
            .select(*postings.columns, "sig_id", "ours", "roles"))


def role_lists(signatures: DataFrame) -> DataFrame:
    """(h, len, sig_id, role, before, ours): hash and length of each role of a signature, the role
    itself, those before it and the skills."""
    roles = signatures.select("sig_id", F.posexplode("roles").alias("place", "role"), "roles", F.col("skill_set").alias("ours"))
    return roles.select(F.xxhash64("role").alias("h"), F.length("role").alias("len"), "sig_id", "role",
                        F.slice("roles", 1, F.col("place")).alias("before"), "ours")


def role_filter(lists: DataFrame) -> tuple[list[int], list[int]]:
    """(the roles' lengths, the words of a bit map of their hashes): what a title needs to know
    of the roles; its size is that of the longest role and of the map."""
    slot = F.pmod("h", F.lit(ROLE_BITS))
    row = lists.agg(F.collect_set("len").alias("len"), F.collect_set(slot).alias("slots")).first()
    words = [0] * (ROLE_BITS // WORD)
    for x in row["slots"]:
        words[x // WORD] |= 1 << (x % WORD)
    return sorted(row["len"]), [w - (1 << WORD) if w >> (WORD - 1) else w for w in words]


def title_substrings(postings: DataFrame, lengths: list[int], words: list[int]) -> DataFrame:
    """The postings with each substring of their title (``tl``, in lower case) of one of the lengths
    whose hash ``h`` the bit map holds, and its place ``at``."""
    slots, at, k = F.lit(words).cast("array<bigint>"), F.col("at"), F.col("k")
    rows = postings.withColumn("tl", F.lower(F.coalesce("title", F.lit("")))).where(F.length("tl") >= min(lengths))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.length("tl") - (min(lengths) - 1))).alias("at"))
    rows = rows.select("*", F.explode(F.lit(lengths).cast("array<int>")).alias("k")).where(at + k <= F.length("tl") + 1)
    rows = rows.select(*postings.columns, "tl", "at", F.xxhash64(F.substring("tl", at, k)).alias("h"))
    slot = F.pmod("h", F.lit(ROLE_BITS))
    return rows.where(F.getbit(F.get(slots, F.floor(slot / WORD).cast("int")), (slot % WORD).cast("int")) == 1)


def by_role(postings: DataFrame, lists: DataFrame, known: tuple[list[int], list[int]] | None = None) -> DataFrame:
    """Postings and signatures (sig_id, ours) where the title holds a target role, each pair once;
    pairs of ``by_skill`` are left out."""
    lengths, words = known or role_filter(lists)
    if not lengths:
        return postings.join(lists.select("sig_id", "ours"), F.lit(False))
    shared = F.array_intersect(F.coalesce("posting_skills", F.array().cast("array<string>")), F.col("ours"))
    first = (F.instr("tl", F.col("role")) == F.col("at")) & ~F.exists("before", lambda r: F.instr(F.col("tl"), r) > 0)
    return (title_substrings(postings, lengths, words).join(lists.drop("len"), "h").where(first & (F.size(shared) < MIN_SKILL_OVERLAP))
            .select(*postings.columns, "sig_id", "ours"))


def signature_match(postings: DataFrame, sets: DataFrame | None, signatures: DataFrame | None, skills: DataFrame | None = None,
                    roles: DataFrame | None = None, frequent: list[str] | None = None) -> DataFrame:
    """Matched (sig_id, posting) pairs with the sorted skill overlap and the role flag.

    ``postings``: posting_id, title (+ company / region / url carried through).
    ``sets``: ``posting_skill_sets``, or None where the postings carry theirs.  ``skills``, ``roles``
    and ``frequent`` are the lists of a standing index; without them they are made from the
    signatures and the sets."""
    frequent = frequent_skills(postings if sets is None else sets, "posting_skills") if frequent is None else frequent
    skills = skill_lists(signatures) if skills is None else skills
    roles = role_lists(signatures) if roles is None else roles
    keep = [c for c in ("posting_id", "title", "company_name", "region", "url") if c in postings.columns]
    rows = postings.where(F.col("posting_id").isNotNull())
    rows = rows.select(*keep, "posting_skills") if sets is None else rows.select(*keep).join(sets, "posting_id", "left")
    tl = F.lower(F.coalesce("title", F.lit("")))
    skilled = by_skill(rows, skills, frequent).withColumn("role_match", F.exists("roles", lambda r: F.instr(tl, r) > 0)).drop("roles")
    pairs = skilled.unionByName(by_role(rows, roles).withColumn("role_match", F.lit(True)))
    overlap = F.array_intersect(F.coalesce("posting_skills", F.array().cast("array<string>")), F.col("ours"))
    return pairs.select("sig_id", *keep, "posting_skills", F.col("ours").alias("profile_skills"),
                        F.sort_array(overlap).alias("overlap"), "role_match")


def for_users(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of signatures as rows of their users."""
    return rows.join(members, "sig_id").drop("sig_id")


def profile_match(postings: DataFrame, posting_skills: DataFrame, profiles: DataFrame,
                  users: DataFrame | None = None) -> DataFrame:
    """Matched (user, posting) pairs: ``signature_match`` written out for every user."""
    members, signatures = profile_signatures(profiles, users)
    return for_users(signature_match(postings, posting_skill_sets(posting_skills), signatures), members)


def notification_rows(matches: DataFrame, key: str = "sig_id") -> DataFrame:
    """In-app notification per match: title, body, link, posting_id, kind."""
    py = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))  # noqa: E731  (f-string of None)
    matched = F.when(F.size("overlap") > 0, F.array_join("overlap", ", ")).otherwise(F.lit(ROLE_MATCH_TEXT))
    body = F.concat(py("title"), F.lit(" at "), py("company_name"), F.lit(" · "), py("region"),
                    F.lit(" · Matching skills: "), matched)
    return matches.select(key, "posting_id",
                          F.concat(F.lit("New match: "), py("title")).alias("title"),
                          body.alias("body"),
                          (F.col("url") if "url" in matches.columns else F.lit(None).cast("string")).alias("link"),
                          F.lit(NOTIFICATION_KIND).alias("kind"))


def match_score(matches: DataFrame, key: str = "sig_id") -> DataFrame:
    """matched = required ∩ have, missing = required − have (sorted), score =
    round-half-even(100 · |matched| / |required|), 0 when nothing is required."""
    req = F.coalesce("posting_skills", F.array().cast("array<string>"))
    matched = F.array_sort(F.array_intersect(req, F.col("profile_skills")))
    missing = F.array_sort(F.array_except(req, F.col("profile_skills")))
    score = F.when(F.size(req) > 0, F.bround(F.size(matched) / F.size(req) * 100, 0).cast("int")).otherwise(0)
    return matches.select(key, "posting_id", "title", "company_name",
                          matched.alias("matched_skills"), missing.alias("missing_skills"),
                          score.alias("match_score"))


def match_report(scored: DataFrame, key: str = "sig_id") -> DataFrame:
    have = F.when(F.size("matched_skills") > 0, F.array_join("matched_skills", ", ")).otherwise(NO_SKILLS_TEXT)
    gaps = F.when(F.size("missing_skills") > 0, F.array_join("missing_skills", ", ")).otherwise(NO_GAPS_TEXT)
    text = F.format_string("Match score: %s%% for '%s' at %s.\nYou have: %s.\nGaps: %s.",
                           F.col("match_score"), F.coalesce(F.col("title"), F.lit("None")),
                           F.coalesce(F.col("company_name"), F.lit("None")), have, gaps)
    return scored.select(key, "posting_id", text.alias("report"))


def notify_once(new: DataFrame, history: DataFrame | None = None,
                order_cols: tuple[str, ...] = ("created_at", "notification_id")) -> DataFrame:
    """At most one notification per (user_id, posting_id): drop keys already in history,
    keep the first new row per key (rows without a posting id are never de-duplicated)."""
    keyed = new.filter(F.col("posting_id").isNotNull())
    if history is not None:
        keyed = keyed.join(history.select("user_id", "posting_id").filter(F.col("posting_id").isNotNull()),
                           ["user_id", "posting_id"], "left_anti")
    rest = [c for c in keyed.columns if c not in ("user_id", "posting_id", *order_cols)]
    dedup = first_rows(keyed, ["user_id", "posting_id"], [*order_cols, *rest])
    return dedup.unionByName(new.filter(F.col("posting_id").isNull()))


def search_terms(profiles: DataFrame, fallback: list[str] | None = None) -> DataFrame:
    """Profile-driven search terms: roles then headline, comma-split, trimmed, 3..40
    characters; then the fallback terms; case-insensitive first-wins dedupe.
    Order is (source, user_id, position); output (term, src, user_id, pos)."""
    spark = profiles.sparkSession
    headline = F.col("headline") if "headline" in profiles.columns else F.lit(None).cast("string")
    raw = F.concat(F.coalesce("target_roles", F.lit("")), F.lit(","), F.coalesce(headline, F.lit("")))
    t = (profiles.select("user_id", F.posexplode(F.split(raw, ",")).alias("pos", "chunk"))
                 .select(F.lit(0).alias("src"), F.col("user_id").cast("bigint").alias("user_id"), "pos",
                         F.trim("chunk").alias("term")))
    if fallback:
        fb = spark.createDataFrame([(1, None, i, x.strip()) for i, x in enumerate(fallback)],
                                   "src int, user_id bigint, pos int, term string")
        t = t.unionByName(fb)
    t = t.filter((F.length("term") >= TERM_MIN_LEN) & (F.length("term") <= TERM_MAX_LEN))
    first = F.min(F.struct("src", F.coalesce("user_id", F.lit(0)).alias("u"), "pos", "term")).alias("f")
    return (t.groupBy(F.lower("term").alias("key")).agg(first)
             .select(F.col("f.term").alias("term"), F.col("f.src").alias("src"),
                     F.col("f.u").alias("user_id"), F.col("f.pos").alias("pos")))


def country_codes(profiles: DataFrame, cli_codes: list[str] | None = None) -> DataFrame:
    """Sorted set of 2-letter lower-case country codes from profiles ∪ the CLI list."""
    spark = profiles.sparkSession
    codes = profiles.select(F.explode(F.split(F.coalesce("countries", F.lit("")), ",")).alias("c")) \
                    .select(F.lower(F.trim("c")).alias("code")).filter(F.length("code") == 2)
    if cli_codes:
        codes = codes.unionByName(spark.createDataFrame([(c.strip().lower(),) for c in cli_codes], "code string"))
    return codes.distinct().orderBy("code")
