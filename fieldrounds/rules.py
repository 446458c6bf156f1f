"""Constants that are part of the meaning of an operator, and the lookup tables it reads."""
from __future__ import annotations

from dataclasses import dataclass, field

# Report sections in the order they are tried (first match wins), matched against
# the lower-case item text without its leading number.
THEME_PATTERNS: tuple[tuple[str, str], ...] = (
    ("knowledge", r"food safety certification|food handler|processor course"),
    ("health", r"communicable disease|discharge from eyes|eating, tasting"),
    ("hands", r"^hands clean"),
    ("handsink", r"handwashing facilit|hand washing station|toilet and handwashing sink"),
    ("temperature",
     r"hot (&|and) cold holding|time as a public health control|cooling method|cooking time|reheating"),
    ("condition", r"returned and reservice|good condition, safe"),
    ("sanitizing", r"^food contact surfaces"),
    ("supplier", r"approved source|shell ?stock|gulf oyster"),
    ("process", r"^compliance with:?$"),
    ("advisory", r"consumer advisory"),
    ("hsp", r"licensed health care facilit|highly susceptible"),
    ("grp_facility",
     r"backflow|water tank|garbage|toilet facilities|vermin-proofing|floors?,? walls|private homes|commissary"),
    ("water", r"hot (&|and) cold water|potable"),
    ("sewage", r"sewage|waste ?water"),
    ("vermin", r"rodents, insects"),
    ("grp_staff", r"person in charge|personal cleanliness"),
    ("grp_food", r"thawing|food separated|vegetables washed|toxic substances"),
    ("grp_storage", r"food storage|consumer self-service|labeled (&|and) honestly"),
    ("grp_equipment", r"non-?food contact|warewashing|equipment ?/ ?utensils|equipment and utensils|vending machines|ventilation|thermometers|wiping cloth"),
    ("grp_signs", r"grade card|identification on vehicle"),
    ("grp_other", r"fire safety"),
)

# The themes whose items may be cited as major.
RISK_THEMES = ("health", "hands", "handsink", "temperature", "condition", "sanitizing", "supplier",
               "process", "hsp", "water", "sewage", "vermin")

# Source visit types and the reading each one gets.
VISIT_TYPES = {"Routine": "routine", "Re-inspection": "reinspection",
               "Site Investigation": "complaint", "Environmental": "complaint",
               "Status Verification": "status_check"}
# Statuses that keep a record, the item status, the rank of statuses of one day, and the record types shown.
OK_STATUS = ("Complete", "Ordered Closed", "Approved to Reopen")
ITEM_STATUS = ("Self Closed",)
STATUS_RANK = {"Ordered Closed": 3, "Self Closed": 2, "Approved to Reopen": 1}
RECORD_TYPES = ("routine", "reinspection", "followup")

# A visit's type in words, and what parts the words of a search.
VISIT_LABELS = {"routine": "routine inspection", "reinspection": "reinspection", "followup": "re-grade or reopening visit",
                "complaint": "complaint or other field visit", "status_check": "status verification"}
SEARCH_SEPARATORS = r"\s*(?:&|/|@|,|\+|\band\b|\bat\b|\bon\b)\s*|\s+"

# Street words written short in addresses and searches.
STREET_WORDS = {"st": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "rd": "road",
                "dr": "drive", "ln": "lane", "ct": "court", "pl": "place", "pkwy": "parkway",
                "hwy": "highway", "ter": "terrace", "cir": "circle"}

# Record facts read over 24 months.
ESCALATION_FLAGS = ("major_2", "closures2", "repeat_item", "lt90_2")

# Business type to the kind of place, and the types that are never scored.
KINDS = {
    "Restaurant Food Facility": "restaurant", "Multiple Kitchen Complex Operation": "restaurant",
    "Low Risk Food Facility": "limited", "Retail Market with Deli": "market",
    "Retail Food Processing": "market", "Pre-Packaged Retail Market": "prepackaged",
    "Prepackaged Cart/Truck": "mobile", "Limited Food Prep Cart": "mobile",
    "Limited Food Prep Truck": "mobile", "Mobile Food Facility Prep Unit": "mobile",
    "Prepackaged Lunch Truck": "mobile", "School Processing Food Facility": "school",
    "School Food Auxiliary Facility": "school", "Caterer": "caterer",
    "Caterer - Direct Sales": "caterer", "Satellite Food Service Operation": "venue",
    "Single Operating Site": "venue", "Host Facility": "venue",
    "Miscellaneous Food Facility": "venue", "Minimal Food Preparation": "venue",
    "Restricted Food Service Facility": "venue", "Boat": "venue",
}
EXCLUDED_TYPES = ("Class A Cottage Food Operation", "Class B Cottage Food Operation",
                  "Microenterprise Home Kitchen", "Vending Machine", "Vending Machine Commissary",
                  "Wholesale Food Warehouse", "Licensed Health Care Facility",
                  "Mobile Food Facility Commissary Processing",
                  "Mobile Food Facility Commissary Non-Processing", "")
PUBLIC_KINDS = ("restaurant", "limited", "market")
# Fixed value: the kinds that bands are made for.
BAND_KINDS = ("restaurant",)


@dataclass(frozen=True)
class Rules:
    """Day counts, shares and thresholds; change one by ``replace(RULES, ...)``."""

    window_days: int = 365
    score_window_days: int = 730
    label_days: int = 365
    active_days: int = 550
    followup_days: int = 30
    record_days: int = 1095          # whole days in 36 months of 30.44 days
    max_items: int = 150
    eligible_days: int = 730
    complaint_days: int = 60
    episode_gap_days: int = 30
    infer_days: int = 14
    closure_score: int = 70
    fill_score: float = 97.0
    trigger_score: int = 90
    epsilon: float = 0.01
    max_features: int = 6
    max_weight: int = 20
    band_shares: tuple[float, ...] = (0.025, 0.075, 0.175)
    band_z: float = 2.326
    curve_min: int = 200
    due_margin: int = 30
    min_gaps: int = 30
    min_cell: int = 11
    max_records: int = 60
    interim_days: tuple[int, ...] = (90, 180, 270)
    report_lag_days: int = 30
    drift_min: float = 0.02
    drift_se: float = 3.0
    oe_range: tuple[float, float] = (0.85, 1.15)
    notice_days: int = 14
    fair_deff: float = 2.0
    themes: tuple[str, ...] = RISK_THEMES
    kinds: dict = field(default_factory=lambda: dict(KINDS))


RULES = Rules()
