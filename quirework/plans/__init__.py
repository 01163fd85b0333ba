from quirework.plans import registry  # noqa: F401
from quirework.plans import conservation, drafts, furniture, glossary, layout, ledger, markdown, pages, planning, quality, reports, structure  # noqa: F401
