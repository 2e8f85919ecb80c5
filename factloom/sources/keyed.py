"""Stored tables with a key: merges and deletes rewrite only the slots that hold a touched key, and count as a whole or not at all.

A folder holds `data/version=.../slot=...` and `commits`, a numbered file per change that names the version of
every slot. A reader takes the last commit and the folders that it names, so that it sees one state however
many writers are at work.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import files_of, settled


class KeyedTable:
    """A table with one row per key, dealt over `slots` by a hash of the key.

    slots and keys are fixed when the table is first written: later ones are read from its commits.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], slots: int = 64):
        self.spark, self.folder, self.keys, self.slots = spark, folder.rstrip("/"), keys, slots
        _, last = self._last()
        if last is not None:
            self.keys, self.slots = last["keys"], last["n_slots"]

    def _last(self) -> tuple[int, dict | None]:
        """The number and content of the last commit; 0 and None for a new table."""
        path, files = files_of(self.spark, f"{self.folder}/commits")
        names = [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return 0, None
        text = self.spark.read.option("wholetext", True).text(f"{self.folder}/commits/{max(numbers):010}.json").first()[0]
        return max(numbers), json.loads(text)

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.slots)).cast("int")

    def _read(self, last: dict | None, slots: list[int] | None = None) -> DataFrame | None:
        """The rows of a commit, or of some of its slots; None if these have never been written."""
        places = [f"{self.folder}/data/version={v}/slot={s}" for s, v in sorted((last or {"versions": {}})["versions"].items()) if v and (slots is None or int(s) in slots)]
        if not places:
            return None
        return self.spark.read.option("basePath", f"{self.folder}/data").option("mergeSchema", True).parquet(*places).drop("version", "slot")

    def rows(self) -> DataFrame | None:
        """The table as the last commit has it; None before the first."""
        return self._read(self._last()[1])

    def _change(self, touched: DataFrame, rewrite: Callable[[DataFrame | None], DataFrame | None], tries: int = 5) -> list[int]:
        """Rewrites the slots of the keys in `touched` and returns them. If another writer commits first, the
        change is made anew on what it left."""
        slots = sorted(r[0] for r in touched.select(self._slot()).distinct().collect())  # at most `slots` numbers
        for _ in range(tries):
            number, last = self._last()
            new = rewrite(self._read(last, slots))
            version, filled = f"v-{uuid.uuid4().hex}", set()
            if new is not None:
                new = settled(new.withColumn("slot", self._slot()))
                filled = {r[0] for r in new.select("slot").distinct().collect()}
                new.repartition("slot").write.partitionBy("slot").parquet(f"{self.folder}/data/version={version}")
            versions = dict((last or {"versions": {}})["versions"]) | {str(s): version if s in filled else None for s in slots}
            if self._commit(number + 1, {"keys": self.keys, "n_slots": self.slots, "versions": versions}):
                return slots
        raise RuntimeError(f"{tries} other writers were faster in {self.folder}")

    def _commit(self, number: int, content: dict) -> bool:
        final, files = files_of(self.spark, f"{self.folder}/commits/{number:010}.json")
        draft, _ = files_of(self.spark, f"{self.folder}/commits/_{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(json.dumps(content).encode())
        out.close()
        done = not files.exists(final) and files.rename(draft, final)
        if not done:
            files.delete(draft, False)
        return done

    def merge(self, new: DataFrame, kept: list[str] | None = None, latest: str | None = None) -> list[int]:
        """Inserts rows or replaces those with equal keys, as `upsert` does (of a replaced row the `kept` columns stay), and
        returns the slots that were rewritten. Doing it again changes nothing."""
        from factloom.operators.facts import upsert

        new = settled(new)

        def rewrite(old: DataFrame | None) -> DataFrame:
            old = old if old is not None else new.limit(0)
            return upsert(old, new, self.keys, kept or [], latest)

        return self._change(new, rewrite)

    def delete(self, gone: DataFrame) -> list[int]:
        """Removes the rows whose keys stand in `gone` and returns the slots that were rewritten."""
        gone = settled(gone.select(*self.keys).distinct())
        return self._change(gone, lambda old: None if old is None else old.join(gone, self.keys, "left_anti"))

    def vacuum(self) -> int:
        """Deletes versions that the last commit does not name and returns how many. No writer or reader may be at work."""
        _, last = self._last()
        good = set((last or {"versions": {}})["versions"].values())
        root, files = files_of(self.spark, f"{self.folder}/data")
        old = [x.getPath() for x in files.listStatus(root) if x.getPath().getName().removeprefix("version=") not in good] if files.exists(root) else []
        return sum(bool(files.delete(p, True)) for p in old)
