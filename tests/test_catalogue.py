from tapeledger.operators import catalogue as C
from tapeledger.sinks.render import audit_report, render_provenance

TRACKER = "id string, name string, announce string, private boolean, source string, health string"
CATALOGUE = [
    ("a", "A", "http://a", False, None, "ANNOUNCES"), ("p", "P", "http://p/{passkey}", True, "ONE", "ANNOUNCES"), ("q", "Q", "http://q", True, "TWO", "ANNOUNCES"),
    ("r", "R", "http://r", True, "ONE", "ANNOUNCES"), ("down", "D", "http://d", False, None, "UNREACHABLE"), ("dead", "X", "http://x", False, None, "BROKEN"),
    ("up", "U", "http://u", False, None, "PERSONAL_UPLOAD"), ("same", "S", "http://a", False, None, "ANNOUNCES"),
]


def test_merge(spark):
    bundled = spark.createDataFrame([(i, *t) for i, t in enumerate(CATALOGUE[:3])], "entry_no long, " + TRACKER)
    user = spark.createDataFrame([(1, "new", "N", "http://n", False, None, "UNCHECKED"), (2, "p", "Mine", "http://m", False, None, "UNCHECKED")], "line_no long, " + TRACKER)
    merged = C.merge_catalogue(bundled, user)
    got = [(r.id, r.origin, r.announce) for r in merged.orderBy("block", "place", "after").collect()]
    assert got == [("a", "BUNDLED", "http://a"), ("p", "USER", "http://m"), ("p", "OVERRIDDEN", "http://p/{passkey}"), ("q", "BUNDLED", "http://q"), ("new", "USER", "http://n")]
    assert tuple(C.catalogue_counts(merged).first()) == (4, 4)


def test_resolve(spark, any_split):
    asked = {
        "plain": ["a", "http://x/y", "down", "up", "same", "http://x/y", "a"],
        "keyed": ["p"], "nokey": ["a", "q", "p2"], "dead": ["a", "dead", "nobody"], "conflict": ["a", "r", "q"], "two": ["r", "p"],
    }
    specs = spark.createDataFrame([(s, i, x) for s, xs in asked.items() for i, x in enumerate(xs)], "set_id string, ordinal long, spec string")
    catalogue = spark.createDataFrame(CATALOGUE + [("p2", "P2", "http://p2/{passkey}", False, None, "ANNOUNCES")], TRACKER)
    resolved = C.resolve_trackers(specs, catalogue, spark.createDataFrame([("p", "k1")], "id string, passkey string"))
    got = {}
    for r in resolved.orderBy("ordinal").collect():
        got.setdefault(r.set_id, []).append(r)
    assert [r.url for r in got["plain"]] == ["http://a", "http://x/y", "http://d", "http://u", None, None, None]
    assert [r.tier for r in got["plain"]] == [0, 1, 2, 3, None, None, None]
    assert [r.warnings for r in got["plain"]] == [[], [], ["UNREACHABLE"], ["PERSONAL_UPLOAD"], ["DUPLICATE_URL"], ["DUPLICATE_URL"], ["DUPLICATE_URL"]]
    assert [(r.url, r.source) for r in got["keyed"]] == [("http://p/k1", "ONE")]
    refusals = {s: (rs[0].refused, rs[0].refused_at) for s, rs in got.items()}
    assert refusals == {"plain": (None, None), "keyed": (None, None), "nokey": ("NO_PASSKEY", 2), "dead": ("BROKEN", 1), "conflict": ("SOURCE_CONFLICT", 2), "two": (None, None)}
    assert all(r.url is None for s in ("nokey", "dead", "conflict") for r in got[s])
    sets = {r.set_id: (r.tiers, r.private, r.source, r.several_private) for r in C.resolved_sets(resolved).collect()}
    assert sets["two"] == (2, True, "ONE", True)
    assert sets["plain"] == (4, False, None, False)


def test_report_and_provenance(spark, tmp_path):
    prov = spark.createDataFrame(
        [("FLAC -> WAV", "a.flac", "a.wav", "ledger", "1.0", None, None, None), ("WAV -> FLAC", "b.wav", "b.flac", "flac", "flac 1.5.0", "/bin/flac", "ab", ["flac", "-8"])],
        "operation string, input string, output string, agent string, version string, tool_path string, sha256 string, argv array<string>",
    )
    got = [r.text for r in render_provenance(prov).orderBy("input").collect()]
    assert got == [
        "FLAC -> WAV: a.flac -> a.wav\n  in-process (ledger 1.0)\n",
        "WAV -> FLAC: b.wav -> b.flac\n  flac 1.5.0\n  /bin/flac (sha256 ab)\n  argv: flac -8\n",
    ]
    audit_report(prov, str(tmp_path / "r"), "2024-01-02")
    audit_report(prov, str(tmp_path / "r"), "2024-01-03")
    back = spark.read.parquet(str(tmp_path / "r"))
    assert (back.count(), back.filter("run_date = DATE'2024-01-02'").count()) == (4, 2)
