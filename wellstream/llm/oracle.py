"""SQL for the registered queries that SQL can express."""

from __future__ import annotations

from wellstream.llm import hard_negatives, manifest

ORACLES: dict[str, str] = {
    "op11_merkle_manifest": manifest.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
