"""Schemas of the tables that the operators take and return."""

SEGMENTS = "tid bigint, id bigint, pos bigint, text string, start_s double, end_s double, is_ad boolean"
MODEL_ANSWER = "tid bigint, segments array<struct<text: string, start: double, end: double>>"
ANSWERS = "tid bigint, chunk_id bigint, apos bigint, id bigint, ad boolean"
TRANSCRIPT = "segments array<struct<id: bigint, text: string, start: double, `end`: double, is_ad: boolean>>, processed_at string"
MESSAGES = "seq bigint, topic string, correlation_id string, file_path string"
SUBMISSIONS = "seq bigint, correlation_id string, type string, url string"
