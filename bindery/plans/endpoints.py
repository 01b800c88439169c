"""The data endpoints of the service and the queries that give what each returns."""

from __future__ import annotations

#: Method and path, and the names of the queries. Endpoints that only start, stop or serve have no data of their own.
ENDPOINTS = {
    "GET /api/jobs": ["job_list", "job_list_by_type", "job_spans"],
    "GET /api/jobs/status/{book_id}": ["live_overlay", "ocr_progress"],
    "GET /api/jobs/status/{book_id}/detailed": ["toc_entries_linked", "cost_stage_groups", "ocr_progress", "book_state"],
    "GET /api/books": ["list_books"],
    "GET /api/books/{id}": ["book_state_lists", "metadata_applied"],
    "GET /api/books/{id}/chapters": ["chapter_skeleton", "chapter_paragraphs", "chapter_pages_range_join"],
    "GET /api/books/{id}/pages": ["page_ocr_nested", "missing_pages"],
    "GET /api/books/{id}/pages/{n}": ["priority_text", "headings_json"],
    "GET /api/books/{id}/export/epub": ["epub_archives", "xhtml", "nav_groups"],
    "GET /api/books/{id}/export/storyteller": ["chapter_audio_ordinal_join", "smil_lines", "segment_files"],
    "GET /api/books/{id}/audio": ["audio_rollup", "audio_offsets", "metric_chapter_attribution"],
    "GET /api/agent-logs": ["agent_log_stages", "log_summary", "recent_runs_topk"],
    "GET /api/metrics": ["metric_list_filtered"],
    "GET /api/metrics/cost": ["total_cost", "cost_rollup_total", "cost_ranked"],
    "GET /api/metrics/summary": ["summary"],
    "GET /api/metrics/detailed": ["stage_detailed_stats"],
    "GET /api/books/{id}/cost": ["book_stage_cost", "book_cost_cache"],
    "GET /api/books/{id}/metrics/detailed": ["detailed_stats"],
    "GET /api/settings": ["key_pivot", "custom_order"],
    "GET /api/llmcalls": ["llmcall_page", "llmcall_filtered"],
    "GET /api/llmcalls/counts/{book_id}": ["llmcall_prompt_counts"],
    "GET /api/prompts": ["override_coalesce", "template_names", "prompt_sync_action"],
}
