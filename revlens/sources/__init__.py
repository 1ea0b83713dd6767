from revlens.sources.feeds import (  # noqa: F401
    FINANCE_MONTHS, load_feeds, read_feed, read_finance, write_result,
)
from revlens.sources.tables import (  # noqa: F401
    finance_feed, invoice_feed, service_feed, ticket_feed,
)
