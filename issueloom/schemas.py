"""Schemas of the tables that are read or made from outside. Nothing is inferred."""

PAGE = "repo string, page long, body string"
REPO_LIST = "repo_pos int, repo string"
ANSWER = "repo string, batch_id long, response string"
