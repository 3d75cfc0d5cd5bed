"""Linked data with provenance: missing values, tops where all are linked to, encoded addresses."""

import json
from urllib.parse import quote

from marlstone.sources import provenance

CONCEPT = "id string, title string, description string, type string, tags array<string>, body string, trust_tier string, attester string, sources array<string>"


def test_nodes(spark):
    rows = [("a b", None, None, None, None, None, None, "Ann & Co (x)!", ["p q", "r'~*"]), ("b", "B", "d", "idea", ["t"], "x", "unverified", "", None), (None, "gone", "", "", [], "", "", "z", None)]
    edges = [("a b", "b", "depends_on"), ("a b", "b", "depends_on"), ("b", "a b", "references"), ("b", "c", "related_to"), ("b", "c", "implements")]
    nodes = provenance.provenance_nodes(spark.createDataFrame(rows, CONCEPT), spark.createDataFrame(edges, "src string, dst string, kind string"), "My Base", "now").collect()
    by = {(n.kind, n.node): json.loads(n.json) for n in nodes}
    assert len(nodes) == len(by) == 5
    # Both are linked to, so that the first one is the top.
    assert by["top", "urn:okf:scheme:my-base"]["hasTopConcept"] == "urn:okf:concept:a b"
    a, b = by["concept", "urn:okf:concept:a b"], by["concept", "urn:okf:concept:b"]
    assert (a["prefLabel"], a["definition"], a["dc:type"], a["schema:keywords"], a["broader"]) == ("a b", "Concept definition for a b", "concept", [], ["urn:okf:concept:b"])
    assert "altLabel" not in a and a["topConceptOf"] == "urn:okf:scheme:my-base" and "topConceptOf" not in b
    assert (b["related"], b["references"], b["implements"]) == (["urn:okf:concept:a b", "urn:okf:concept:c"], ["urn:okf:concept:a b"], ["urn:okf:concept:c"]) and "wasGeneratedBy" not in b
    act = by["activity", a["wasGeneratedBy"]]
    safe = "!~*'()"
    assert act["prov:wasAssociatedWith"]["@id"] == "urn:okf:attester:" + quote("Ann & Co (x)!", safe=safe) and act["prov:used"] == ["urn:okf:source:" + quote(s, safe=safe) for s in ("p q", "r'~*")]
    terms = json.loads(provenance.context())
    assert all(k in terms or ":" in k or k.startswith("@") for n in by.values() for k in n)


def test_empty_bundle(spark):
    nodes = provenance.provenance_nodes(spark.createDataFrame([], CONCEPT), spark.createDataFrame([], "src string, dst string, kind string"), "", "now").collect()
    assert [n.kind for n in nodes] == ["scheme"] and nodes[0].node == "urn:okf:scheme:okf-enterprise"
