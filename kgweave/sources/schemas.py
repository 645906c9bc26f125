"""Graph schemas as small tables: entity types, relation types and the label pairs they may join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgweave.sources.biomedical import ACTIONS, LABELS

#: Relation types by structural label, per source (fixed values).
SCHEMAS = {
    "bgee": {"ANA-GEN": ("EXPRESSION_PRESENT", "EXPRESSION_ABSENT")},
    "ctd": {"EXP-DIS": ("EXPOSURE_DISEASE",), "EXP-GEN": ("EXPOSURE_GENE",), "EXP-EXP": ("EXPOSURE_EXPOSURE",), "EXP-BPO": ("EXPOSURE_BIOLOGICAL_PROCESS",), "EXP-CCO": ("EXPOSURE_CELLULAR_COMPONENT",), "EXP-MFN": ("EXPOSURE_MOLECULAR_FUNCTION",)},
    "disgenet": {"DIS-GEN": ("ASSOCIATED_WITH",), "PHE-GEN": ("ASSOCIATED_WITH",)},
    "drugbank": {"DRG-GEN": ("TARGET", "ENZYME", "TRANSPORTER", "CARRIER", "OTHER"), "DRG-DRG": ("DRUG_INTERACTION",)},
    "drugcentral": {k: ("INDICATION", "CONTRAINDICATION", "OFF_LABEL_USE") for k in ("DRG-DIS", "DRG-PHE")},
    "gene_ontology": {f"{k}-{k}": ("PARENT",) for k in ("BPO", "CCO", "MFN")},
    "onsides": {"DRG-PHE": ("ADVERSE_DRUG_REACTION",)},
    "opentargets": {**{f"{k}-GEN": ("ASSOCIATED_WITH",) for k in ("DIS", "PHE", "ANA", "BPO", "CCO", "MFN")}, "DIS-DIS": ("PARENT",), "PHE-PHE": ("PARENT",), "DIS-PHE": ("HAS_PHENOTYPE",), "DRG-DIS": ("INDICATION",), "DRG-GEN": ACTIONS},
    "ppi": {"GEN-GEN": ("INTERACTS_WITH",)},
    "reactome": {"PWY-PWY": ("PARENT",)},
}


def allowed_triples(spark: SparkSession, source: str) -> DataFrame:
    """``(head_label, type, tail_label)`` of a source's schema, for ``validate_graph``."""
    rows = [(LABELS[k[:3]], t, LABELS[k[4:]]) for k, types in SCHEMAS[source].items() for t in types]
    return spark.createDataFrame(rows, "head_label string, type string, tail_label string")


def extraction_schema(spark: SparkSession, entity_types: list[tuple[str, str]], relation_types: list[tuple[str, list[str], list[str]]]) -> tuple[DataFrame, DataFrame]:
    """A schema given at run time: entity types ``(label, description)`` and allowed triples of relation types ``(type, head labels, tail labels)``;
    an empty list of labels allows all."""
    every = [e[0] for e in entity_types]
    triples = [(h, t, x) for t, heads, tails in relation_types for h in (heads or every) for x in (tails or every)]
    return spark.createDataFrame(entity_types, "label string, description string"), spark.createDataFrame(triples, "head_label string, type string, tail_label string")
