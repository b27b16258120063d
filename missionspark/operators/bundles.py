"""Checks over all tables of mission bundles: references and ids, mission by mission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import check_refs
from .logs import repeated_ids

#: References: kind -> (table, column, known tables and columns).  A column that holds an array is a list of references.
REFERENCES = {
    "identity_link": ("observations", "linked_track_id", [("observations", "track_id")]), "track_supersedes": ("observations", "supersedes", [("observations", "observation_id")]),
    "node_supersedes": ("nodes", "supersedes", [("nodes", "delta_id"), ("edges", "delta_id")]), "delta_supersedes": ("edges", "delta_supersedes", [("nodes", "delta_id"), ("edges", "delta_id")]),
    "node_track": ("nodes", "track_id", [("observations", "track_id")]), "edge_subject": ("edges", "subject_id", [("nodes", "node_id")]), "edge_object": ("edges", "object_id", [("nodes", "node_id")]),
    "edge_supersedes": ("edges", "supersedes", [("edges", "edge_id")]), "edge_evidence": ("edges", "evidence_ids", [("observations", "observation_id"), ("samples", "sample_id")]),
    "proposal_supersedes": ("proposals", "supersedes", [("proposals", "proposal_id")]), "event_supersedes": ("events", "supersedes", [("events", "event_id")]),
    "event_participant": ("events", "participants", [("observations", "track_id"), ("nodes", "node_id")]), "event_delta": ("events", "delta_refs", [("nodes", "delta_id"), ("edges", "delta_id")]),
    "event_claim": ("events", "claim_ref", [("proposals", "proposal_id")]), "event_evidence_track": ("events", "evidence_tracks", [("observations", "track_id")]), "event_evidence_file": ("events", "evidence_files", [("files", "path")]),
    "qa_evidence": ("timeline_qa", "evidence_event_ids", [("events", "event_id")]), "mask_track": ("masks", "track_id", [("observations", "track_id")]),
}
#: Ids that occur once in a mission: kind -> columns of tables that share the kind.
UNIQUE = {
    "observation_id": ["observations"], "delta_id": ["nodes", "edges"], "proposal_id": ["proposals"], "event_id": ["events"], "qa_id": ["qa"], "timeline_qa_id": ["timeline_qa"], "node_id": ["nodes"], "edge_id": ["edges"], "sample_id": ["samples"],
}


def _id(column: str | Column) -> Column:
    return F.concat_ws("/", F.col("mission_id").cast("string"), (F.col(column) if isinstance(column, str) else column).cast("string"))


def _wanted(table: DataFrame, column: str) -> DataFrame:
    if table.schema[column].dataType.typeName() == "array":
        table = table.select("mission_id", F.explode(column).alias(column))
    return table.filter(F.col(column).isNotNull()).select(_id(column).alias("ref"))


def dangling(bundle: dict[str, DataFrame]) -> DataFrame:
    """References of all kinds whose id isn't in their mission: (kind, id, n); answers of log and timeline that differ are a kind, too."""
    known = {kind: None for kind in REFERENCES}
    for kind, (_, _, targets) in REFERENCES.items():
        for table, column in targets:
            rows = bundle[table].select(_id(column).alias("known"))
            known[kind] = rows if known[kind] is None else known[kind].unionByName(rows)
    found = check_refs({kind: (_wanted(bundle[table], column), "ref", known[kind], "known") for kind, (table, column, _) in REFERENCES.items()})
    log, shown = (bundle[t].select(_id("qa_id").alias("id"), F.col("answer").alias(t)) for t in ("qa", "timeline_qa"))
    both = log.join(shown, "id", "full")
    differ = both.filter(~F.col("qa").eqNullSafe(F.col("timeline_qa"))).groupBy("id").agg(F.count("*").alias("n")).select(F.lit("qa_log").alias("kind"), "id", "n")
    return found.unionByName(differ)


def repeated(bundle: dict[str, DataFrame], n_ids: int | None = None) -> DataFrame:
    """Ids of the nine kinds that occur more than once in a mission: (kind, id, n); ``n_ids`` as in :func:`repeated_ids`."""
    ids = {}
    for kind, names in UNIQUE.items():
        column = "qa_id" if kind == "timeline_qa_id" else kind
        for name in names:
            ids.setdefault(name, {})[kind] = F.when(F.col(column).isNotNull(), _id(column))
    return repeated_ids([(bundle[name], kinds) for name, kinds in ids.items()], n_ids).filter("id is not null")
