"""The stand-alone run of pairwise matching: master, queue, evidence and audit."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame

from lakewarden import fixed_values as fv
from lakewarden.config import Thresholds
from lakewarden.functions.columns import pick_column, run_time
from lakewarden.operators import match_pairs as mp
from lakewarden.operators.golden import duplicates, golden_master
from lakewarden.operators.keyed import Skew
from lakewarden.sources.store import TableStore, staged, write_csv, write_parquet, write_report


@dataclass(frozen=True)
class PairMatching:
    """Tables of one matching run. `members` and `scored` are staged; the rest is lazy."""

    prepared: DataFrame
    members: DataFrame
    scored: DataFrame
    id_column: str
    thresholds: Thresholds

    @classmethod
    def over(cls, records: DataFrame, id_column: str, name_column: str,
             block_column: str | None, thresholds: Thresholds = Thresholds(), *,
             skew: Skew = Skew()) -> PairMatching:
        prepared = mp.prepare(records, id_column, name_column, block_column)
        members = staged(mp.members(prepared, id_column), "match-members")
        scored = staged(mp.match_names(members, thresholds, skew=skew), "match-names")
        return cls(prepared, members, scored, id_column, thresholds)

    @classmethod
    def over_zones(cls, zones: DataFrame, thresholds: Thresholds = Thresholds(), *,
                   skew: Skew = Skew()) -> PairMatching:
        """Zone tables name their zones in one of two columns and may come without boroughs."""
        name = pick_column(zones, (fv.ZONE_NAME, fv.ZONE_NAME_ALTERNATIVE))
        if name is None:
            raise ValueError(f"no column with zone names; the table has {zones.columns}")
        block = pick_column(zones, (fv.ZONE_AREA,))
        return cls.over(zones, fv.ZONE_KEY, name, block, thresholds, skew=skew)

    def blocks(self) -> DataFrame:
        return mp.block_report(self.members, self.scored)

    def master(self, moment: dt.datetime | None = None) -> DataFrame:
        """One survivor per key over all records; pair decisions do not change it."""
        return golden_master(self.prepared, ["match_key"], self.id_column, moment=moment)

    def audit(self, lineage: dict[str, object] | None = None) -> DataFrame:
        return mp.pair_audit(self.prepared, self.blocks(), self.scored, self.thresholds, lineage)

    def write(self, store: TableStore, root: str, job_name: str,
              moment: dt.datetime | None = None) -> dict[str, str]:
        """Write every output under `root`; evidence lies beside the report, not under it."""
        moment = run_time(moment)
        places = {n: f"{root}/{n}" for n in (
            "master", "steward_queue", "block_report", "duplicate_keys", "duplicate_ids",
            "matched_names", "merge_links", "audit")}
        written = store.write(self.master(moment), places["master"])
        write_parquet(mp.by_confidence(mp.steward_pairs(self.scored, moment=moment)),
                      places["steward_queue"])
        write_parquet(self.blocks(), places["block_report"])
        write_csv(duplicates(self.prepared, "match_key"), places["duplicate_keys"])
        write_csv(duplicates(self.prepared, self.id_column), places["duplicate_ids"])
        write_parquet(mp.by_confidence(self.scored), places["matched_names"])
        write_parquet(mp.merge_links(self.members), places["merge_links"])
        write_report(self.audit({
            "master_out_path": places["master"], "master_format": written.format,
            "steward_queue_path": places["steward_queue"],
            "rejects_path": places["block_report"], "job_name": job_name,
            "generated_at_utc": moment,
        }), places["audit"])
        return places
