"""A standing index of profile signatures for the match stream, in versions.

Profiles arrive as deltas: ``commit`` writes the changed rows as a version of their own and then
notes the version.  ``advance`` brings the index to a version and reads only the deltas behind
it: the changed users' signatures, the signatures that are new with their inverted skill and role
lists, and the users' new places.  Nothing written before is read for it but the list of known
signature ids, and nothing is rewritten.  ``at`` gives the index as of a version, so a batch that
is run again sees the profiles it saw the first time; ``version_of`` notes that version per batch.

All tables lie in one folder of the shared storage, partitioned by ``version``; a version's
folders are overwritten by a run that failed in between and take part only once it is noted.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlake.operators import matching

PROFILE_ROWS = "user_id long, email string, skills string, target_roles string"
TABLES = {
    "profiles": PROFILE_ROWS,
    "members": "user_id long, email string, sig_id string",
    "signatures": "sig_id string, skill_set array<string>, roles array<string>",
    "skill_lists": "skill string, sig_id string, ours array<string>, roles array<string>",
    "role_lists": "h long, len int, sig_id string, role string, before array<string>, ours array<string>",
    "held": "sig_id string",
    "versions": "changed long",
    "indexed": "frequent array<string>",
    "batches": "used long",
}


@dataclass
class View:
    """The index as of one version."""

    version: int
    members: DataFrame
    signatures: DataFrame
    skills: DataFrame
    roles: DataFrame
    frequent: list[str]


class ProfileIndex:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        for name, schema in TABLES.items():  # an empty first version, so every table can be read
            if name != "batches" and not self._written(name, 0):
                self._put(name, 0, spark.createDataFrame([(0,)] if name == "versions" else [([],)] if name == "indexed" else [], schema))

    # -- tables ------------------------------------------------------------------------------
    def _folder(self, name: str, version: int) -> str:
        return f"{self.base}/{name}/version={version}"

    def _written(self, name: str, version: int) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder(name, version)}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _put(self, name: str, version: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self._folder(name, version))

    def _upto(self, name: str, version: int) -> DataFrame:
        return (self.spark.read.schema(f"{TABLES[name]}, version long").parquet(f"{self.base}/{name}")
                .where(F.col("version") <= version))

    def _of(self, name: str, version: int) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(self._folder(name, version))

    def _last(self, name: str) -> int:
        return self.spark.read.schema(f"{TABLES[name]}, version long").parquet(f"{self.base}/{name}").agg(F.max("version")).first()[0]

    # -- versions ----------------------------------------------------------------------------
    def latest(self) -> int:
        return self._last("versions")

    def commit(self, changed: DataFrame) -> int:
        """Changed profiles (user_id, email, skills, target_roles; empty skills take the user out)
        as the next version; one row per user."""
        version = self.latest() + 1
        self._put("profiles", version, changed.select("user_id", "email", "skills", "target_roles"))
        self._put("versions", version, self._of("profiles", version).agg(F.count(F.lit(1)).alias("changed")))
        return version

    def advance(self, version: int) -> None:
        """Index the versions up to ``version``, each from its own delta."""
        for v in range(self._last("indexed") + 1, version + 1):
            changed = self._of("profiles", v)
            members, found = matching.profile_signatures(changed)
            known = self._upto("signatures", v - 1).select("sig_id")
            self._put("signatures", v, found.join(known, "sig_id", "left_anti").select("sig_id", "skill_set", "roles"))
            fresh = self._of("signatures", v)
            self._put("skill_lists", v, matching.skill_lists(fresh))
            self._put("role_lists", v, matching.role_lists(fresh))
            gone = changed.join(members.select("user_id"), "user_id", "left_anti").select("user_id", "email", F.lit(None).cast("string").alias("sig_id"))
            self._put("members", v, members.select("user_id", "email", "sig_id").unionByName(gone))
            self._put("held", v, self._members(v).select("sig_id").distinct())
            frequent = matching.frequent_skills(self._upto("signatures", v), "skill_set")
            self._put("indexed", v, self.spark.createDataFrame([(frequent,)], TABLES["indexed"]))

    def _members(self, version: int) -> DataFrame:
        latest = F.max(F.struct("version", "email", "sig_id")).alias("l")
        return (self._upto("members", version).groupBy("user_id").agg(latest)
                .select("user_id", "l.email", "l.sig_id").where("sig_id is not null"))

    def at(self, version: int) -> View:
        held = self._of("held", version)  # a signature that nobody has any more matches nothing
        signatures, skills, roles = (self._upto(n, version).drop("version").join(held, "sig_id", "left_semi")
                                     for n in ("signatures", "skill_lists", "role_lists"))
        return View(version, self._members(version), signatures, skills, roles, list(self._of("indexed", version).first()["frequent"]))

    def version_of(self, batch_id: int) -> int:
        """The version that a batch uses: the one noted for it, or the latest, noted now."""
        if not self._written("batches", batch_id):
            self._put("batches", batch_id, self.spark.createDataFrame([(self.latest(),)], TABLES["batches"]))
        return self._of("batches", batch_id).first()["used"]
