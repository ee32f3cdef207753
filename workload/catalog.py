from workload import live  # noqa: F401
from workload import returns  # noqa: F401
from workload import ranking  # noqa: F401
from workload import series  # noqa: F401
from workload import tables  # noqa: F401
from workload.base import ORACLES, QUERIES  # noqa: F401
