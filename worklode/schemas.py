"""Schemas of the relations, and the named constants of retrieval."""

REF = "struct<session_id:string,start_offset:bigint,end_offset:bigint>"
CLAIMS = (
    "id string, type string, project_key string, workspace_root string, harness string, session_id string, created_at string, text string, "
    "why string, paths array<string>, symbols array<string>, path_mtime map<string,bigint>, status string, supersedes string, source string, "
    f"claim_hash string, transcript_ref {REF}, seq bigint"
)
MESSAGES = "project_key string, session_id string, harness string, source string, offset bigint, role string, text string, error boolean, skip boolean"
EXCERPTS = "id string, session_id string, project_key string, start_offset bigint, end_offset bigint, text string, month string"
ACTIONS = "seq bigint, project_key string, session_id string, kind string, claim_id string, paths array<string>, tokens array<string>, at string"
SESSIONS = "jsonl string, session_id string, harness string, workspace string, project_key string, seq bigint"
TERMS = "record_id string, project_key string, term string, tf int, doc_len int, seq bigint"
VECTORS = "record_id string, project_key string, model string, dim int, vec array<float>"
REQUESTS = "request_id string, question string, goal string, project string, workspace_root string, paths array<string>, session_id string, limit_tokens int, now timestamp"
HITS = (
    "request_id string, rank int, id string, type string, text string, when string, paths array<string>, harness string, status string, source string, "
    "has_excerpt boolean, score double, warning string"
)

# -- fixed values: caps, thresholds and weights of retrieval -------------------
CANDIDATE_CAP = 400
FTS_CAP = 80
PER_KEY_CAP, POSTING_CAP = 40, 80
TYPE_CAP, RECENT_FAILED_CAP = 40, 8
INFER_PATHS, INFER_TYPE_CAP, INFER_FIRST = 6, 24, 40
VECTOR_CAP = 120
#: Requests whose projects and models are broadcast; blocks of request vectors have twice as many.
VECTOR_BATCH = 4096
#: Vectors, and sets of words, of a block.
VECTOR_BLOCK, SET_BLOCK = 32768, 16384
ACTION_CAP = 40
HEAD_CAPS = {"failed": 12, "decision": 10, "constraint": 8}
COLD_PRIORITY_CAP, COLD_PATH_CAP, COLD_STATE_CAP = 30, 40, 10
PACK_CAP, PACK_TYPE_CAP = 5, 2
STALE_CAP = 30
DEFAULT_LIMIT = 1200
HALF_LIFE_DAYS = {"failed": 14, "decision": 180, "state": 7, "thread": 7}
DIVERSITY, CONFLICT, INVALIDATE, VECTOR_GATE = 0.8, 0.35, 0.2, 0.55
RICH_TOKENS = 2
TAPE_TAIL_BYTES = 64000
TAIL_MESSAGES, TAIL_BYTES, QUESTION_BYTES, COMPILE_PATHS, RECENT_CLAIMS = 40, 32000, 500, 8, 8
W_FAILED, W_SHIPPED, W_FAILED_WEAK, W_SHIPPED_WEAK = 4.0, 2.5, 0.25, 0.24
W_AGREE, W_SERVED, W_DWELL, W_OFF_PATH, W_STALE, W_COVERAGE = 0.4, 0.9, 0.8, 0.5, 0.7, 0.8
STRONG_TOKENS, STRONG_SYMBOL = 2, 0.25
#: profile -> weights of (type, path, symbol, bm25, vector, recency, agree)
MIX = {
    "path": (1.5, 1.8, 0.8, 0.4, 0.4, 0.2, 0.4),
    "ident": (1.5, 0.8, 1.6, 0.5, 0.9, 0.2, 0.4),
    "prose": (1.2, 0.6, 0.6, 1.3, 1.3, 0.2, 0.4),
    "head": (2.0, 1.2, 0.0, 0.0, 0.0, 0.2, 0.0),
}
EXCERPT_MIN, EXCERPT_TARGET = 800, 1200
EXTRACT_CAP, EXTRACT_TYPE_CAP, DIR_CAP, DIR_CAP_LASTING = 12, 5, 2, 5
