"""Relations of the engine: latency logs, transcripts, ratings, runs.

The canonical interchange is the long metric table (run_id, item, metric, value).
"""

from __future__ import annotations

from pyspark.sql import types as T

# The stages of a turn, in pipeline order.
STAGES = ("stt", "stt_endpoint_delay", "llm_prompt_eval", "llm_ttft", "llm_first_chunk_fill", "llm_ttfc", "tts_first_chunk", "ttfa", "llm_eval", "tts_total", "e2e_response_ready")
HEADLINE_STAGES = ("stt", "llm_ttft", "llm_ttfc", "ttfa", "e2e_response_ready")
CONTEXT = ("mode", "stt_engine", "tts_engine", "input_mode", "audio_pacing", "utterance_trigger")
RESOURCES = ("cpu_percent", "ram_percent", "rss_mb", "llm_rss_mb", "llm_vram_mb", "llm_model_vram_mb", "gpu_util_percent", "gpu_mem_used_mb", "gpu_mem_total_mb")

#: As written; everything is text until clean.numeric() has looked at it.
LOG_COLUMNS = ("ts_iso", *CONTEXT, "item", "stage", "duration_ms", *RESOURCES[:8], "gpu_mem_total_mb", "gpu_name", "extra_json")
LOG_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in dict.fromkeys(LOG_COLUMNS)])

# Bits a weight of each weight format, in lower case.
PRECISION_BITS = {
    "fp32": 32, "f32": 32, "fp16": 16, "f16": 16, "bf16": 16,
    "q8_0": 8, "q8": 8, "q6_k": 6, "q5_k_m": 5, "q5_k_s": 5, "q5_1": 5, "q5_0": 5,
    "q4_k_m": 4, "q4_k_s": 4, "q4_1": 4, "q4_0": 4, "q3_k_m": 3, "q3_k_l": 3, "q3_k_s": 3, "q2_k": 2,
}
