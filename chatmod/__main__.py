from chatmod.app import main

main()
