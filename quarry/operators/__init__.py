"""Index building, search and scoring."""
