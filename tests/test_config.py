from datetime import date

import pytest

from campaign_lift.config import CampaignConfig, expand_dates, normalise_store_codes, resolve_selection
from campaign_lift.functions.columns import date_runs
from tests.conftest import config


def test_dates_expand_in_either_order():
    days = (date(2024, 2, 28), date(2024, 2, 29), date(2024, 3, 1))
    assert expand_dates(days[0], days[2]) == days
    assert expand_dates(days[2], days[0]) == days
    assert expand_dates(days[0], days[0]) == days[:1]
    assert expand_dates(None, days[0]) == ()


def test_store_codes_are_padded_and_deduplicated():
    assert normalise_store_codes(["7", 7, "0007", "", None, "12", "12345"]) == ("0007", "0012", "12345")


def test_unknown_promo_mechanism_is_refused():
    with pytest.raises(ValueError, match="mechanism"):
        config(promo_mechanism="RP")


def test_selection_modes():
    options = ["a", "b", "c"]
    assert resolve_selection(options, "all") == ("a", "b", "c")
    assert resolve_selection(options, "include", ["c", "a"]) == ("c", "a")
    assert resolve_selection(options, "except", ["b"]) == ("a", "c")
    assert resolve_selection(options, "except", options) == ()
    with pytest.raises(ValueError):
        resolve_selection(options, "some")


def test_empty_dates_or_stores_are_refused():
    with pytest.raises(ValueError, match="date"):
        config(baseline_dates=[], promo_dates=[])
    with pytest.raises(ValueError, match="store"):
        config(groups={"Group 1": [], "Group 3": []})
    with pytest.raises(ValueError, match="unknown groups"):
        config(pairs=[("Group 1", "Group 9")])


def test_selected_dates_are_a_sorted_union():
    cfg: CampaignConfig = config(baseline_dates=[date(2024, 1, 2), date(2024, 1, 1)], promo_dates=[date(2024, 1, 2)])
    assert cfg.selected_dates == (date(2024, 1, 1), date(2024, 1, 2))


def test_group_labels():
    cfg = config(descriptions={"Group 1": " blue ", "Group 2": "  "})
    assert cfg.group_label("Group 1") == "Group 1 (blue)"
    assert cfg.group_label("Group 2") == "Group 2"
    assert cfg.group_label("Group 3") == "Group 3"


def test_date_runs():
    days = [date(2024, 1, 3), date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 9), date(2024, 1, 9)]
    assert date_runs(days) == [(date(2024, 1, 1), date(2024, 1, 3)), (date(2024, 1, 9), date(2024, 1, 9))]
    assert date_runs([]) == []


def test_default_pair_needs_both_groups():
    assert config().pairs == (("Group 1", "Group 3"),)
    assert config(groups={"North": ["1"], "South": ["2"]}).pairs == ()
