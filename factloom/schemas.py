"""Constants of the memory model: closed sets and limits that results depend on."""

from __future__ import annotations

# Limits of the model.
FANOUT = 64
CITATION_BYTES = 160
MESSAGE_BYTES = 65_536
WINDOW_BYTES = 4096
EVIDENCE_PAGE = 32
EVIDENCE_TEXT_BYTES = 262_144
STATEMENT_BYTES = 65_536
VERSION_BYTES = 256
ANCHOR_WORDS = 4
MAX_TERMS = 512
MAX_ANCHORS = 256
BUDGET_CHARACTERS = 16_000
BUDGET_ROWS = 200
SURFACE_BYTES = 2000
REPORT_SURFACE_BYTES = 8000
REPORT_INPUT_BYTES = 1_048_576
REPORT_BUDGET = 12_000
RETAINED_GENERATIONS = 2
ARTIFACT_BYTES = 524_288
ARTIFACT_NAME_BYTES = 256
ARTIFACT_SUBJECT_BYTES = 1024
COMMUNITY_RESOLUTION = 0.05
COMMUNITY_SIZE = 24
FINER_FACTORS = (2, 4, 8, 16)
BRANCH = 8
VERBATIM = 8
MAX_LEVEL = 6
MIN_GAP_RUN = 2
SEGMENT_BYTES = 8192
ALIAS_CEILING = 64
MUTATIONS = 20
SEAL_BATCH = 100_000

BACKLOG = 4096
BACKLOG_PER_PROJECT = 512

# Forms of names, and the namespace in which segments name themselves.
PREDICATE_NAME = "^[a-z][a-z_]*[a-z]$"
PROJECT_NAME = "^[a-z][a-z0-9_]{0,62}$"
SEGMENT_NAMESPACE = "6f1d8a1e-3b7c-4d2a-9f0e-5c4b3a2d1e0f"

# Closed sets.
SURFACES = ["facts", "reports", "passages"]
ARTIFACT_KINDS = ["state", "file"]
ROLES = ["user", "assistant", "tool", "system"]
ENTITY_TYPES = ["person", "organisation", "place", "thing", "event", "concept"]
CARDINALITY_ONE = ["has_name", "has_role", "lives_in", "born_in", "has_timezone", "instance_of", "located_in", "occurred_on", "scheduled_for", "due_on", "has_status"]
EVENT_PREDICATES = ["created", "contributed_to", "participated_in", "occurred_on", "born_in"]
REASONS = [
    "unmapped_relation", "unresolvable_subject", "unresolvable_object", "unlocatable_quote", "not_asserted", "not_current",
    "duplicate_claim", "conflicting_value", "not_spoken_by_principal", "entity_name_limit",
]
SPEAKER_TERMS = ["i", "me", "myself", "the user", "user", "أنا", "انا", "نفسي"]
# Kinds of derived rows, and whether a row survives while another source supports it.
PROJECTION_KINDS = {
    "chunk": True, "fact": True, "entity": True, "rejected_claim": True, "community_report": False, "fact_history": False, "agent_artifact": False,
    "message_embedding": False, "entity_embedding": False, "report_embedding": False, "segment": False, "feedback": False,
}
# Upper bounds of duration buckets, in milliseconds.
DURATION_BOUNDS = [5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000]

# Predicates of the adapters' vocabulary: semantic type, cardinality, kind of object, whether an event.
VOCABULARY = [
    ("lives_in", "location", "one", "place", False),
    ("located_in", "location", "one", "place", False),
    ("part_of", "structure", "many", "place", False),
    ("created", "authorship", "many", "thing", True),
    ("has_status", "state", "one", "concept", False),
    ("likes", "preference", "many", "thing", False),
    ("knows", "social", "many", "person", False),
]
