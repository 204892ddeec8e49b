from caselight.functions.derive import *  # noqa: F401,F403
from caselight.functions.text import *  # noqa: F401,F403
