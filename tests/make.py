"""Landed issues for the tests."""

CREATED = "2022-05-06T07:08:09Z"


def landed_issue(number, repo="o/a", **fields):
    """An open issue as it lands, with `fields` put in or, if their value is `...`, left out."""
    whole = dict(
        state="open",
        number=number,
        html_url=f"https://tracker/{repo}/{number}",
        title=f"No. {number}",
        body=f"what {repo} says in {number}",
        labels=[dict(name="ui")],
        comments=2,
        updated_at="2022-06-01T00:00:00Z",
        created_at=CREATED,
    )
    return {k: v for k, v in (whole | fields).items() if v is not ...}
