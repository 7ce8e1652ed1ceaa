"""Entities by four stages, typed corpora, fused rankings, and the snapshot they refer to."""

import json

from lodestone.operators import search
from lodestone.sources import readers

ALIASES = "alias string, entity_id long, embedding array<float>, attack_id string"
MENTIONS = "mention_id long, name string, embedding array<float>"


def snapshot(tmp_path):
    ref = lambda i: [{"source_name": "capec", "external_id": "CAPEC-1"}, {"source_name": "mitre-attack", "external_id": i}]
    objects = [
        {"type": "attack-pattern", "id": "attack-pattern--1", "name": "Shell", "external_references": ref("T1059"), "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "execution"}, {"kill_chain_name": "other", "phase_name": "x"}]},
        {"type": "attack-pattern", "id": "attack-pattern--2", "name": "Prompt", "external_references": ref("T1059.003"), "revoked": True},
        {"type": "intrusion-set", "id": "intrusion-set--1", "name": "Blue Heron", "aliases": ["Blue Heron", "Heron-7"], "external_references": ref("G0901")},
        {"type": "malware", "id": "malware--1", "name": "Pail", "x_mitre_aliases": ["Pail", "Bucket"], "x_mitre_deprecated": True, "external_references": ref("S0901")},
        {"type": "x-mitre-tactic", "id": "x-mitre-tactic--1", "name": "Execution", "external_references": ref("TA0002")},
        {"type": "identity", "id": "identity--1", "name": "Somebody"},
        {"type": "tool", "id": "tool--1", "name": "No id"},
    ]
    (tmp_path / "bundle.json").write_text(json.dumps({"type": "bundle", "id": "bundle--1", "objects": objects}, indent=1))
    return str(tmp_path / "bundle.json")


def test_snapshot(spark, tmp_path):
    rows = readers.attack(spark, snapshot(tmp_path))
    got = {r.attack_id: (r.kind, r.name, list(r.aliases), list(r.tactics), r.parent_id, r.active) for r in rows.collect()}
    assert got == {
        "T1059": ("technique", "Shell", [], ["execution"], None, True),
        "T1059.003": ("technique", "Prompt", [], [], "T1059", False),
        "G0901": ("group", "Blue Heron", ["Heron-7"], [], None, True),
        "S0901": ("software", "Pail", ["Bucket"], [], None, False),
        "TA0002": ("tactic", "Execution", [], [], None, True),
    }
    assert sorted(map(tuple, readers.attack_names(rows).collect())) == [("Blue Heron", "G0901"), ("Heron-7", "G0901")]


def test_four_stages(spark, tmp_path):
    names = readers.attack_names(readers.attack(spark, snapshot(tmp_path)))
    aliases = spark.createDataFrame(
        [("Red Fox", 1, [1.0, 0.0], None), ("red-fox", 2, None, None), ("Кот", 3, [0.0, 1.0], None), ("Fourth", 4, [0.0, 0.0], "G0901"), ("Fourth", 5, None, "G0901"), (None, 6, [0.0, -1.0], None), ("??", 7, None, None)], ALIASES
    )
    mentions = spark.createDataFrame(
        [(1, "red-fox", None), (2, "RED FOX!", None), (3, "кот.", None), (4, "пёс", None), (5, "x", [2.0, 0.1]), (6, "y", [1.0, 1.0]), (7, "heron 7", None), (8, "heron 7", [0.0, 3.0]), (9, None, [0.0, -2.0]), (10, None, None), (11, "!!", None), (12, "z", [0.0, 0.0])], MENTIONS
    )
    got = {r.mention_id: (r.entity_id, r.stage) for r in search.resolve_entities(mentions, aliases, names).collect()}
    assert got == {
        1: (2, "exact"), 2: (1, "normalised"), 3: (3, "normalised"), 4: (None, None), 5: (1, "embedding"), 6: (None, None), 7: (4, "attack"), 8: (3, "embedding"),
        9: (6, "embedding"), 10: (None, None), 11: (None, None), 12: (None, None),
    }
    assert search.resolve_entities(mentions, aliases.limit(0), names).where("stage IS NOT NULL").count() == 0


def test_shared_texts_once(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "item_id long, text string, source string, embedding array<float>")
    items = search.corpora(attack=rows((1, "same", "a", [1.0, 0.2]), (2, "own", "a", [0.0, 1.0])), stix=rows((1, "same", "b", [1.0, 0.0]), (2, None, "b", [1.0, 1.0]), (3, "bare", "b", None)))
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = {(r.corpus, r.item_id, r.rank) for r in search.context(items, asked, k=2).collect()}
    assert got == {("stix", 1, 1), ("stix", 2, 2), ("attack", 2, 2)}


def test_no_hits(spark):
    docs = spark.createDataFrame([(1, "one"), (2, None)], "doc_id long, text string")
    vectors = spark.createDataFrame([(2, [1.0, 0.0])], "doc_id long, embedding array<float>")
    edges = spark.createDataFrame([("a", "b")], "source_ref string, target_ref string")
    links = spark.createDataFrame([(3, "b"), (3, "z")], "doc_id long, node string")
    got = search.unified_search(spark, docs, vectors, edges, links, ["absent"], [1.0, 0.0], "a")
    assert [(r.doc_id, r.lexical_rank, r.vector_rank, r.graph_rank) for r in got.collect()] == [(2, None, 1, None), (3, None, None, 1)]
