from claimspark.streaming.score_stream import request_stream, score_requests, start_scoring  # noqa: F401
