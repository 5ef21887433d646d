from rankflow.sources.readers import *  # noqa: F401,F403
from rankflow.sources.quarantine import *  # noqa: F401,F403
