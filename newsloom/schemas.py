"""Table layouts, as DDL strings, and the keys that identify their rows."""

ARTICLES = "article_id bigint, source string, title string, url string, published_at timestamp, summary string, content_hash string, raw_excerpt string, collected_at timestamp"
SCORES = "article_id bigint, provider string, model string, relevance_score int, category string, signal string, confidence string, summary string, why_it_matters string, source_citation string, model_raw string, scored_at timestamp"
ANALYSES = "article_id bigint, profile_id string, scoring_provider string, scoring_model string, analysis_provider string, analysis_model string, category string, entity string, impact string, suggested_action string, model_raw string, analyzed_at timestamp"
TRACKER = "id bigint, article_id bigint, profile_id string, scoring_provider string, scoring_model string, analysis_provider string, analysis_model string, item_date timestamp, source string, category string, title string, summary string, relevance_score int, entity string, impact string, suggested_action string, owner string, status string, original_link string, created_at timestamp, updated_at timestamp"

SCORE_KEY = ["article_id", "provider", "model"]
LINEAGE_KEY = ["article_id", "profile_id", "scoring_provider", "scoring_model", "analysis_provider", "analysis_model"]
