import pytest

from hushlake import CustomRule, SanitizeConfig
from hushlake.rules import KNOWN_CATEGORIES, selected_rules, tie_ranks


def test_defaults():
    cfg = SanitizeConfig()
    assert (cfg.mode, cfg.confidence_threshold) == ("pii", 0.85)
    assert cfg.max_text_length == cfg.max_file_bytes == float("inf")
    from_file = SanitizeConfig.from_mapping({})
    assert from_file.max_text_length == 2_000_000 and from_file.max_file_bytes == 25 * 1024 * 1024


def test_bad_values():
    with pytest.raises(ValueError):
        SanitizeConfig(mode="loud")
    with pytest.raises(ValueError):
        SanitizeConfig(confidence_threshold=1.1)


def test_mapping():
    cfg = SanitizeConfig.from_mapping(
        {"document_sanitization": {
            "mode": "strict", "enable": "email, name,", "disable": ["name "], "confidence_threshold": "0.9",
            "rules": [{"name": "my id", "pattern": "x"}, {"name": "b", "pattern": "y", "replacement": "[Q]", "confidence": 0.5}],
        }}
    )
    assert cfg.mode == "strict" and cfg.confidence_threshold == 0.9
    assert cfg.enable_categories == ("EMAIL", "NAME") and cfg.disable_categories == ("NAME",)
    assert cfg.custom_rules == (CustomRule("my id", "x", "[MY ID]"), CustomRule("b", "y", "[Q]", 0.5))
    assert cfg.custom_rules[0].category == "MY_ID"
    assert cfg.allows("email") and not cfg.allows("name") and not cfg.allows("JWT")


def test_resolve_and_override():
    cfg = SanitizeConfig.resolve({"mode": "pii", "disable": "PHONE", "enable": "EMAIL"}, "strict")
    assert cfg.mode == "strict"
    out = cfg.override(disable="amount,phone", enable="jwt", custom_rules=[{"name": "a", "pattern": "b"}])
    assert out.disable_categories == ("PHONE", "AMOUNT") and out.enable_categories == ("JWT",)
    assert len(out.custom_rules) == 1 and SanitizeConfig.resolve(None).mode == "pii"


def test_tiers_are_cumulative():
    sizes = [len(selected_rules(SanitizeConfig(mode=m))) for m in
             ("off", "secrets_only", "pii", "confidential", "strict")]
    assert sizes == [0, 6, 13, 15, 17] and len(KNOWN_CATEGORIES) == 16


def test_ties_prefer_confidence_then_order():
    rules = selected_rules(SanitizeConfig(mode="strict"))
    ranks = dict(zip([r.category for r in rules], tie_ranks(rules), strict=True))
    assert ranks["MYKAD"] < ranks["LONG_NUMBER"] and ranks["ACCOUNT_NUMBER"] < ranks["LONG_NUMBER"]


def test_registry_is_complete():
    from hushlake.plans.queries import ORACLES, QUERIES

    assert len(QUERIES) >= 69 and set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize(
    "settings",
    [
        {"mode": "off"}, {"mode": "pii"}, {"mode": "strict", "confidence_threshold": 0.93},
        {"mode": "confidential", "disable_categories": ("NAME", "JWT")},
        {"mode": "strict", "enable_categories": ("NAME", "AMOUNT"), "disable_categories": ("AMOUNT",)},
    ],
)
def test_rules_as_a_table(spark, settings):
    from hushlake.rules import rules_table, select_rules_table

    cfg = SanitizeConfig(**settings)
    rows = select_rules_table(rules_table(spark), cfg).orderBy("rule_ord").collect()
    assert [r.category for r in rows] == [r.category for r in selected_rules(cfg)]
