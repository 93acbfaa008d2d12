"""Document retrieval on Spark: files to chunks to vectors to ranked passages."""

from passagemill.plans.ingest import ingest, load_documents, rebuild
from passagemill.plans.search import answer_questions, build_prompts, search
from passagemill.session import build_session
from passagemill.settings import Settings
from passagemill.sources.store import load_store, reload_store

__all__ = [
    "Settings", "answer_questions", "build_prompts", "build_session", "ingest", "load_documents",
    "load_store", "rebuild", "reload_store", "search",
]
