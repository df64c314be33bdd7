from codestrata.sources.files import *  # noqa: F401,F403
from codestrata.sources.views import *  # noqa: F401,F403
