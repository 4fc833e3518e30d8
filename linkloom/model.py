"""Fixed values of the data model: typed keys, event kinds, phases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Key -> (priority, value type, directed).
KEYS = {
    "N_Name": (2, "string", False),
    "I_UNII": (3, "string", False),
    "I_CAS": (2, "string", False),
    "I_SID": (1, "long", False),
    "I_CID": (2, "long", False),
    "I_ChEMBL": (2, "string", False),
    "I_DB": (2, "string", False),
    "I_CODE": (1, "string", False),
    "I_MeSH": (2, "string", False),
    "I_UniProt": (2, "string", False),
    "I_NCT": (1, "string", False),
    "I_PMID": (2, "long", False),
    "I_ANY": (1, "long", False),
    "I_GENE": (1, "string", False),
    "H_InChIKey": (3, "string", False),
    "H_LyChI_L1": (0, "string", False),
    "H_LyChI_L2": (0, "string", False),
    "H_LyChI_L3": (0, "string", False),
    "H_LyChI_L4": (2, "string", False),
    "H_LyChI_L5": (3, "string", False),
    "H_SHA1": (5, "string", False),
    "H_SHA256": (5, "string", False),
    "H_MD5": (4, "string", False),
    "U_Wikipedia": (1, "string", False),
    "U_DOI": (1, "string", False),
    "R_subClassOf": (1, "string", True),
    "R_equivalentClass": (1, "string", False),
    "R_exactMatch": (1, "string", False),
    "R_closeMatch": (1, "string", False),
    "R_axiom": (1, "string", False),
    "R_rel": (1, "string", False),
    "R_hasPhenotype": (1, "string", False),
    "R_activeMoiety": (5, "string", True),
    "R_ppi": (1, "string", False),
    "T_Keyword": (1, "string", False),
}

# Event kinds, best first; those that count as approved and as marketed.
EVENT_KINDS = "USApprovalOTC USApprovalRx USApprovalAllergenic USWithdrawn USUnapproved USPreviouslyMarketed Marketed Discontinued Withdrawn Clinical Excipient Designation USAnimalDrug Other Publication Filing".split()
APPROVED = ["USApprovalOTC", "USApprovalRx"]
MARKETED = [*APPROVED, "USApprovalAllergenic", "USPreviouslyMarketed", "Marketed", "Discontinued"]
PHASES = ["Not Applicable", "Early Phase 1", "Phase 1", "Phase 1/Phase 2", "Phase 2", "Phase 2/Phase 3", "Phase 3", "Phase 4"]


def keys_between(lower: int, upper: int) -> list[str]:
    """Keys whose priority lies in [lower, upper]; a bound of 0 or less is open."""
    return [k for k, (p, _, _) in KEYS.items() if (lower <= 0 or p >= lower) and (upper <= 0 or p <= upper)]


def keys_of_type(kind: str) -> list[str]:
    return [k for k, (_, t, _) in KEYS.items() if t == kind]


def key_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in KEYS.items()], "key string, priority int, type string, directed boolean")
