

# first, so that whichever of its modules is asked for, all are loaded in the registry's order
from plumbline.plans import registry  # noqa: E402, F401
