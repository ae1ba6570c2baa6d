"""Names, limits, tables and patterns that results depend on."""

from __future__ import annotations

# Fixed values of record resolution.
PENDING_ERROR = (
    r"(?i)memory|MemoryBudget|OOM|timeout|timed out|Timeout|evaluator_error|"
    r"APIError|APIConnection|Connection|ServerError|InternalServerError|exhausted|"
    r"RateLimit|\b429\b|\b5\d\d\b"
)
OVER_BUDGET_ERROR = "CallOverBudget"
UNSTAMPED_VERSION = "2.0"
CORE_CASES = 100

# Fixed values of rail names.
GROUND_NAMES = ["GND", "AGND", "DGND", "SGND", "PGND", "EGND", "GROUND", "VSS", "VSSA", "VSSD", "V-", "VEE", "0V"]
SUPPLY_NAMES = ["VCC", "VDD", "VCCA", "VCCD", "VDDA", "VDDD", "AVCC", "DVCC", "AVDD", "DVDD", "VBUS", "VBAT", "VIN", "VOUT", "VPP", "V+"]
VOLTAGE = r"^\d{1,2}(?:\.\d{1,2})?V\d{0,2}$"
NEUTRAL = r"^(?:[A-Z]|\d+)$"
SEGMENT_BREAK = r"[_/\s+\-]+"

# Fixed values of component types: which predicted types a true type accepts; None: any.
TYPE_COMPATIBILITY = {
    "fuse": ["fuse", "ferrite_bead", "resistor"],
    "buzzer": None,
    "transformer": None,
    "ferrite_bead": ["ferrite_bead", "inductor"],
    "capacitor_polarized": ["capacitor", "capacitor_polarized"],
}

# Fixed values of spatial matching and fault rules.
COMPONENT_TOLERANCE, COMPONENT_CAP = 0.005, 0.02
TERMINAL_TOLERANCE, TERMINAL_CAP = 0.025, 0.05
NEAREST_MARGIN, DUPLICATE_DISTANCE = 0.005, 0.0005
FATAL_SHARE, OPEN_PIECES, OPEN_SHARE = 0.70, 2, 0.80
K_SHORT, K_OPEN = 3.0, 3.0

# Fixed values of geometry scores.
IOU_WEIGHT, TOPOLOGY_WEIGHT = 0.8, 0.2
BOM_WEIGHT, ORIENT_WEIGHT, FIT_WEIGHT, LAYOUT_WEIGHT = 0.15, 0.25, 0.30, 0.30
LEAST_SHARE, FULL_BASE = 0.001, 1e-6
RIGID_TOLERANCE = 1e-6
PAIR_DISTANCE, CONTACT_DISTANCE = 0.35, 0.6

# Fixed values of sheet layout.
API_LONG_PX, TILE_MIN_CAP, TILE_PX, TILE_OVERLAP, CAP_PER_EM = 2048, 10.0, 2300, 0.10, 0.7
TILE_GRIDS = [(1, 2), (2, 1), (2, 2), (2, 3), (3, 2), (3, 3), (3, 4), (4, 3), (4, 4), (4, 5), (5, 5)]
DEFAULT_LETTERING_MM, CONTENT_TEXT_MM, CONTENT_MARGIN, FOOTER_BAND = 2.5, 2.3, 0.01, 0.955
INK_THRESHOLD, FRAME_RUN, PIXEL_DIFFERENCE, BACKGROUND_DISTANCE, BLACK = 200, 0.6, 8, 12, 40
OUTPUT_LIMIT_BYTES = 10_000

# Fixed values of instance hits.
HIT_IOU, SURFACE_TOLERANCE = 0.5, 0.02

# Fixed values of text: the line between the two ends of a limited output, separators of a class digest, byte limits.
OMITTED_LINE = "\n[... output limited to {most} bytes; {gone} interior bytes omitted ...]\n"
CLASS_PREFIX, CLASS_SEPARATOR, CLASS_DIGITS = "g-", "|", 12
JSON_LIMIT_BYTES, JSON_LIMIT_DEPTH = 32 << 20, 64
ROUNDS_ONLY = "%s rounds"
BUDGET_ONLY = "at most %s output tokens, your thinking included -- the episode ends when they are spent"
ROUNDS_AND_BUDGET = "at most %s rounds and %s output tokens, your thinking included -- the episode ends at whichever runs out first"
ROUND, TOKENS_SPENT = "Round %s", " \u00b7 output tokens %s / %s"
SHEET_KINDS, SHEET_FOLDER = ["alone", "in_assembly"], "parts"

# Fixed values of the matching tie-break: multipliers and offset of the hash, its shifts and width, scale of weights.
TIE_ROW, TIE_COLUMN, TIE_OFFSET, TIE_SALT, TIE_MIX = 0x9E3779B1, 0x85EBCA77, 0x27D4EB2F, 0xC2B2AE3D, 0xBF58476D1CE4E5B9
TIE_SHIFTS, TIE_BITS, TIE_SCALE, TIE_LEVELS = (29, 32), 34, 42, 1 << 16

# Fixed values of symmetry: types whose two terminals are interchangeable; packages whose name gives no number of pins.
PAIRWISE_TYPES = ["resistor", "capacitor", "inductor", "ferrite_bead", "crystal", "fuse"]
PACKAGE_PINS = {"SMA-TH": 1, "SW-SMD": 2, "SW-TH": 2}
PIN_COUNT = r"(?i)[-_](\d{1,2})P(?:IN)?(?:[-_]|$)"
EDGE_SLACK = 1e-9

# Fixed values of mesh identity, topology and voxel grids.
LEAST_FACES, DEGENERATE_AREA = 10, 1e-9
VERTEX_TOLERANCE, INVARIANT_TOLERANCE = 1e-6, 1e-6
SURFACE_IDENTITY, GATE_TOLERANCE, FARTHEST, NOISE_FACTOR = 2e-4, 5e-3, 3, 1.5
GRID, GRID_SIZE = 128, 133

# Fixed values of the budget record.
DEFAULT_RESERVE, STANDARD_BUDGET = 64_000, 500_000
GENERATION_PATHS = r"(/messages$|/responses$|/chat/completions$|:generateContent$|:streamGenerateContent$)"
SUMMARIZE_FREE_TOKENS = 8_000

# Fixed values of task declarations: the settings of a task with their defaults (None: required), and what they may hold.
TASK_DEFAULTS = {
    "id": None, "kind": None, "submission": None, "given": None, "inputs": "[]", "renderer": "none", "inject": "[]", "verify_entry": None, "orientation": None,
    "oracle": "", "band_exclude_families": "[]", "band_exclude_cases": "[]", "band_exclude_reason": "", "source_repo": None, "split": None,
    "metric": "legacy", "pose_mode": "expert-fit", "avg_part_types": "all", "scale": "fixed",
}
TASK_KEYS = {
    "id": "task.id", "kind": "task.kind", "submission": "task.submission", "given": "task.given", "inputs": "task.inputs", "renderer": "tools.renderer", "inject": "tools.inject",
    "verify_entry": "verify.entry", "orientation": "verify.orientation", "oracle": "verify.oracle", "band_exclude_families": "verify.band_exclude_families",
    "band_exclude_cases": "verify.band_exclude_cases", "band_exclude_reason": "verify.band_exclude_reason", "source_repo": "data.source_repo", "split": "data.split",
    "metric": "verify.metric", "pose_mode": "verify.pose_mode", "avg_part_types": "verify.avg_part_types", "scale": "verify.scale",
}
TASK_VALUES = {
    "kind": ["part", "assembly", "ecad"], "orientation": ["free", "pinned", "n/a"], "given": ["nothing_3d", "purchased_parts_step", "all_parts_step", "renders_only"],
    "split": ["open", "heldout"], "renderer": ["none", "shared"], "avg_part_types": ["all", "modelled"], "scale": ["fixed", "free"],
    "metric": ["legacy", "asm_v1", "part_v1", "part_x_asm_v1", "ecad_v2"], "pose_mode": ["expert-fit", "iou24_aligned"],
}
