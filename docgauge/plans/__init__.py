"""Plans: the full evaluation and the catalogue of queries."""


def load():
    """The catalogue with every query module imported."""
    from docgauge.plans import catalog
    import docgauge.plans.text_queries  # noqa: F401
    import docgauge.plans.core_queries  # noqa: F401
    import docgauge.plans.family_queries  # noqa: F401
    import docgauge.plans.report_queries  # noqa: F401
    import docgauge.plans.whole_queries  # noqa: F401

    return catalog
