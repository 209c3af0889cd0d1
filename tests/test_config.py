from __future__ import annotations

import copy

import pytest

from stridelake.config import DEFAULT_LANDING_CONFIG, ConfigError, enabled_assets, validate_config


def cfg():
    return copy.deepcopy(DEFAULT_LANDING_CONFIG)


def test_default_config_is_valid():
    assert validate_config(cfg()) is not None


def test_assets_must_be_mapping():
    with pytest.raises(ConfigError, match="assets"):
        validate_config({"assets": []})


def test_enabled_asset_needs_fields():
    c = cfg()
    del c["assets"]["splits"]["target_table"]
    with pytest.raises(ConfigError, match="target_table"):
        validate_config(c)


def test_disabled_asset_is_not_checked():
    c = cfg()
    c["assets"]["splits"] = {"enabled": False}
    validate_config(c)
    assert "splits" not in enabled_assets(c)


def test_column_mapping_non_empty_list():
    c = cfg()
    c["assets"]["workouts"]["column_mapping"] = []
    with pytest.raises(ConfigError, match="non-empty"):
        validate_config(c)


def test_payload_kind_rules():
    c = cfg()
    c["assets"]["activities"]["extract"] = {"payload_kind": "csv"}
    with pytest.raises(ConfigError, match="unsupported payload_kind"):
        validate_config(c)
    c = cfg()
    c["assets"]["splits"]["extract"] = {"payload_kind": "object"}
    with pytest.raises(ConfigError, match="records_path"):
        validate_config(c)
    c = cfg()
    del c["assets"]["activity_details"]["extract"]["values_path"]
    with pytest.raises(ConfigError, match="values_path"):
        validate_config(c)


def test_enabled_defaults_to_true():
    c = cfg()
    c["assets"]["activities"].pop("enabled")
    assert "activities" in enabled_assets(c)


def test_layout_of_list_files():
    c = copy.deepcopy(DEFAULT_LANDING_CONFIG)
    c["assets"]["activities"]["extract"]["layout"] = "lines"
    assert validate_config(c) is c
    c["assets"]["splits"]["extract"]["layout"] = "lines"
    c["assets"]["activities"]["extract"]["layout"] = "columns"
    with pytest.raises(ConfigError) as e:
        validate_config(c)
    assert "activities: extract.layout 'columns'" in str(e.value) and "splits: extract.layout 'lines'" in str(e.value)
